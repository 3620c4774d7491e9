"""Cleaning of texts that a language model wrote: reference marks, JSON answers, notes and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import BLANK, collapse

# Rewrites that take marks such as (#3, #7) out of a text, in order.
REFERENCE_MARKS = [
    (r"[（(]\s*#\d+(?:\s*[、,，和与]\s*#?\d+)*\s*[)）]", ""),
    (r"#\d+(?![A-Za-z0-9_])", ""),
    (r"[（(]\s*[、,，和与\s]*[)）]", ""),
    (r"[ \t]{2,}", " "),
    (r"(、){2,}", "、"),
    (r"[、,，]+\s*([)）])", "$1"),
    (r"([（(])\s*[、,，]+", "$1"),
    (r"、\s*([。；;.!？?])", "$1"),
    (r"[ \t]+([。；;.!？?，,）)])", "$1"),
]
# Marks at the ends of notes, the last clause that says nothing, and tags that say nothing.
QUOTES = "[\"“”'']"
FILLER = r"[，,；;。]?\s*(?:非常|十分|很|尤其)?值得[^。！？]*[。！？]?$"
TAG_NOISE = ["人工智能", "ai", "开源", "工具", "项目", "github", "开源项目", "开源工具"]
NOTE_LEAST, NOTE_MOST, CUT_LEAST = 8, 70, 12


def without_marks(c: Column) -> Column:
    """A text without marks of numbered items and what they leave behind."""
    for pattern, to in REFERENCE_MARKS:
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def json_array(c: Column) -> Column:
    """The first JSON array in an answer with fences or prose around it, as an array of JSON texts; null if there is none."""
    plain = F.regexp_replace(F.regexp_replace(c, "(?i)```(?:json)?", ""), f"^{BLANK}+|{BLANK}+$", "")
    inner = F.nullif(F.regexp_extract(plain, r"(?s)\[.*\]", 0), F.lit(""))
    chosen = F.when(F.json_array_length(plain).isNotNull(), plain).when(F.json_array_length(inner).isNotNull(), inner)
    return F.from_json(chosen, "array<string>")


def unquoted(c: Column) -> Column:
    """Without quotation marks at its ends, white space as single spaces."""
    return collapse(F.regexp_replace(c, f"^{QUOTES}+|{QUOTES}+$", ""))


def comment(c: Column, n: int = 50) -> Column:
    """A short comment: unquoted, at most n characters."""
    return F.substring(unquoted(c), 1, n)


def _last(c: Column, mark: str, n: int) -> Column:
    """The place, from 0, of the last mark among the first n characters; -1 if there is none."""
    head = F.substring(c, 1, n)
    return F.when(F.contains(head, F.lit(mark)), F.length(head) - F.instr(F.reverse(head), mark)).otherwise(-1)


def note(c: Column, fresh: bool = False) -> Column:
    """A one-line note of 8 to 70 characters that ends with a full stop, without its last clause if that says nothing; else null.

    fresh: straight from the model; what is too long is cut at a clause and a missing full stop is added.  Of a stored note both mean
    that it was cut, so that it is null.
    """
    s = F.regexp_replace(unquoted(c), FILLER, "。")
    s = F.regexp_replace(F.regexp_replace(s, r"[，,；;、]\s*。$", "。"), r"([。！？])[。！？]+$", "$1")
    if fresh:
        cut = F.greatest(*(_last(s, m, NOTE_MOST) for m in "。，；"))
        s = F.when(F.length(s) <= NOTE_MOST, s).when(cut >= CUT_LEAST, F.concat(s.substr(F.lit(1), cut), F.lit("。")))
        s = F.when(s.rlike("[。！？.!?]$"), s).otherwise(F.concat(s, F.lit("。")))
    good = s.rlike("[。！？.!?]$") & F.length(s).between(NOTE_LEAST, NOTE_MOST)
    return F.when((c != "") & good, s)


def tags_of(answer: Column, full_name: Column) -> Column:
    """At most eight tags of a repository from a JSON object of arrays by name, case aside; null if it has none.

    Tags are unquoted, of 2 to 16 characters, and not among the words that fit every repository.
    """
    body = F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))
    pairs = F.map_entries(F.from_json(body, "map<string,string>"))
    own = F.get(F.reverse(F.filter(pairs, lambda e: F.lower(F.trim(e["key"])) == F.lower(full_name))), F.lit(0))["value"]
    raw = F.when(F.json_array_length(own).isNotNull(), F.from_json(own, "array<variant>"))
    texts = F.transform(F.filter(raw, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: collapse(F.regexp_replace(v.cast("string"), QUOTES, "")))
    good = F.array_distinct(F.filter(texts, lambda t: F.length(t).between(2, 16) & ~F.lower(t).isin(TAG_NOISE)))
    return F.when(F.size(good) > 0, F.slice(good, 1, 8))


def to_rewrite(stored: Column, clean=without_marks) -> Column:
    """Whether cleaning changes a stored text, so that it has to be written again."""
    return F.coalesce(clean(stored) != stored, F.lit(False))


def sections(markdown: Column) -> Column:
    """(title, body) of the second-level sections of a Markdown text; what comes before the first has an empty title."""
    parts = F.split(markdown, r"(?m)^##(?!#)[ \t]*")
    head = F.filter(F.array(F.struct(F.lit("").alias("title"), F.regexp_replace(F.get(parts, F.lit(0)), r"^\s+|\s+$", "").alias("body"))), lambda s: s["body"] != "")
    rest = F.transform(F.slice(parts, 2, 1 << 20), lambda p: F.struct(F.trim(F.regexp_extract(p, r"^[^\n]*", 0)).alias("title"), F.regexp_replace(F.regexp_replace(p, r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body")))
    return F.concat(head, rest)
