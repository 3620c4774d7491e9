"""Text functions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers see it; Java's \s lacks the non-breaking and ideographic spaces.
BLANK = "[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
# Named character references that are decoded.
REFERENCES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "hellip": "…", "mdash": "—", "ndash": "–", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "middot": "·"}
# Words that story tokens leave out.
STOP_WORDS = "the a an of to in for and or on with is are was at by as its it be from how why what when your you we our this that new now ai llm llms vs via into not no up out about more can will just hn show".split()


_BEGIN, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_EDGE = f"(?:{_BEGIN}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_]){_END})"
_WORDS = r"\((?:\?:)?[A-Za-z0-9]+(?:\|[A-Za-z0-9]+)*\)"


def word_edges(pattern: str) -> str:
    """A pattern with \\b as it is over ASCII words; Java's \\b counts letters of all scripts.

    Before a letter, digit or list of plain words only what comes before matters, and after such only what comes next.
    """
    pattern = re.sub(rf"\\b(?=[A-Za-z0-9]|{_WORDS})", _BEGIN, pattern)
    pattern = re.sub(rf"((?<!\\)[A-Za-z0-9]|{_WORDS})\\b", lambda m: m[1] + _END, pattern)
    return pattern.replace("\\b", _EDGE)


def collapse(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"{BLANK}+", " "), "^ | $", "")


def _decoded(ref: Column) -> Column:
    """The character of one reference; an unknown one stays as it is."""
    name = F.lower(F.regexp_extract(ref, "^&(.*);$", 1))
    code = F.when(name.startswith("#x"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.nullif(F.regexp_extract(name, "^#([0-9]{1,10})$", 1), F.lit(""))).cast("long")
    char = F.when(((code > 0) & (code < 0xD800)) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    named = F.try_element_at(F.create_map(*(F.lit(x) for pair in REFERENCES.items() for x in pair)), name)
    return F.coalesce(char, named, ref)


def decode_references(c: Column) -> Column:
    """Named, decimal and hexadecimal character references as characters, in one pass."""
    pattern = "(?i)&(?:#x?[0-9a-f]+|[a-z0-9]+);"
    plain, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    parts = F.zip_with(plain, found, lambda p, r: F.concat(p, F.coalesce(_decoded(r), F.lit(""))))
    return F.when(F.contains(c, F.lit("&")), F.array_join(parts, "")).otherwise(c)


def clean_html(c: Column) -> Column:
    """Text of an HTML fragment: script and style gone, tags as spaces, references decoded after that, spaces collapsed."""
    c = F.regexp_replace(c, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return collapse(decode_references(F.regexp_replace(c, "<[^>]*>", " ")))


def truncated(c: Column, n: int) -> Column:
    """At most n characters, with an ellipsis where something was cut."""
    c = collapse(c)
    return F.when(F.length(c) > n, F.concat(F.regexp_replace(F.substring(c, 1, n), f"{BLANK}+$", ""), F.lit("…"))).otherwise(c)


def clamped(c: Column, n: int) -> Column:
    """Trimmed, then cut; null if nothing is left."""
    c = F.substring(F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", ""), 1, n)
    return F.when(c != "", c)


def url_key(c: Column) -> Column:
    """Host and path in lower case, without scheme, query, fragment and last slashes."""
    plain = F.regexp_replace(F.regexp_replace(c, "^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), "[?#].*$", "")
    return F.lower(F.regexp_replace(plain, "/+$", ""))


def title_key(c: Column) -> Column:
    """A title without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(c), f"{BLANK}|[\\p{{P}}\\p{{S}}]", "")


def story_tokens(c: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Distinct ASCII words of two or more characters without stop words, pairs of neighbouring CJK characters, and those that stand alone."""
    low = F.lower(c)
    latin = F.transform(F.regexp_extract_all(low, F.lit("[a-z0-9][a-z0-9.-]*"), F.lit(0)), lambda w: F.regexp_replace(w, "^[.-]+|[.-]+$", ""))
    latin = F.filter(latin, lambda w: (F.length(w) >= 2) & ~w.isin(*stop))
    runs = F.regexp_extract_all(low, F.lit("[\\x{4E00}-\\x{9FFF}]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: r.substr(i, F.lit(2))))))
    return F.array_distinct(F.concat(latin, pairs))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def day(*times: Column) -> Column:
    """The first ten characters of the first time that isn't null."""
    return F.substring(F.coalesce(*times, F.lit("")), 1, 10)


def half_up(c: Column) -> Column:
    """Rounded to the nearest whole number, halves upward."""
    return F.floor(c + 0.5)


def escaped(c: Column) -> Column:
    """For XML text and attributes."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def compact_number(c: Column) -> Column:
    """38.1k from 10,000, 381k from 100,000, else with thousands separators."""
    return F.when(c >= 100_000, F.concat(half_up(c / 1000).cast("string"), F.lit("k"))).when(c >= 10_000, F.concat(F.format_number(c / 1000, 1), F.lit("k"))).otherwise(F.format_number(c, 0))


def hash_slot(c: Column, slots: int = 10) -> Column:
    """A slot from 0 for a text: the absolute value of its 31-polynomial over UTF-16 units in 32 bits, modulo slots."""
    units = F.hex(F.encode(c, "UTF-16BE"))
    codes = F.transform(F.sequence(F.lit(0), (F.length(units) / 4 - 1).cast("int")), lambda k: F.conv(units.substr(k * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    wrapped = lambda h: F.pmod(h + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: wrapped(h * 31 + x))
    return F.when(c == "", 0).otherwise((F.abs(total) % slots).cast("int"))


def source_id(prefix: Column, seed: Column) -> Column:
    """A short stable id: the prefix and ten hexadecimal digits of the seed's SHA-1."""
    return F.concat_ws("-", prefix, F.substring(F.sha1(seed), 1, 10))


def host(url: Column) -> Column:
    """The host of a URL in lower case; null if it can't be read."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


# Ranges of pictographs.
PICTOGRAPHS = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{2300}-\\x{23FF}\\x{2190}-\\x{21FF}\\x{00A9}\\x{00AE}\\x{203C}\\x{2049}\\x{2122}\\x{2139}\\x{3030}\\x{303D}\\x{3297}\\x{3299}]\\x{FE0F}?"


def without_emoji(c: Column) -> Column:
    """A text without pictographs; what white space they leave becomes one space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, PICTOGRAPHS, ""), f"{BLANK}{{2,}}", " "), f"^{BLANK}+|{BLANK}+$", "")


def blurb(note: Column, summary: Column) -> Column:
    """The note, or else the summary's first 58 characters; empty without both."""
    s = collapse(summary)
    return F.when(F.coalesce(note, F.lit("")) != "", note).when(F.length(s) > 60, F.concat(F.substring(s, 1, 58), F.lit("…"))).otherwise(F.coalesce(s, F.lit("")))


def last_of(array: Column, n: int) -> Column:
    """The last n entries of an array, all of a shorter one."""
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), F.lit(n))


def highlighted(c: Column, word: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """A text with every occurrence of a word, case aside, between two marks."""
    safe = lambda x: x.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, f"(?i)({re.escape(word)})", f"{safe(before)}$1{safe(after)}") if word else c
