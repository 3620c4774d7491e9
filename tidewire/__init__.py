"""A PySpark library for content analytics: feeds, scores, reports, stories, boards and search over item tables."""
