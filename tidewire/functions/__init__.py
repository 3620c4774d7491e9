"""Column functions: text cleaning, keys, tokens and dates."""
