"""Fill-in-middle transformation: texts cut into units by zero-width boundaries, and two of the cuts chosen by a hash.

A unit grammar is translated to a regular expression that matches the empty places between units and nothing else: each
place has a character of one class before it and of another after it.  Spark's split at these places keeps every character
of the text, in order, in exactly one piece.  Everything is a column expression; no row leaves its task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of a hundred texts, those that are transformed, and of a hundred of these, those in suffix-prefix-middle order.
TRANSFORMED, SUFFIX_FIRST = 50, 80
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Grammar:
    """Units of a text as runs of character classes.

    classes: a one-letter name for each class and the inside of its brackets; every character is in exactly one class.
    units: what a unit may be, as names that each may have one of ? * + behind them.
    Only grammars that can be cut by looking at two neighbours are allowed; others raise a ValueError.
    """

    classes: tuple[tuple[str, str], ...]
    units: tuple[str, ...]

    def __post_init__(self) -> None:
        names, inside, unit = [name for name, _ in self.classes], self.neighbours(), re.compile("|".join(f"(?:{u})" for u in self.units))
        for text in ("".join(x) for k in range(1, 6) for x in product(names, repeat=k)):
            cut = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in inside]
            if [m.end() for m in unit.finditer(text)] != [*cut, len(text)] or unit.sub("", text):
                raise ValueError(f"{self.units} isn't decided by neighbouring characters: {text}")

    def neighbours(self) -> set[str]:
        """The pairs of class names that can stand side by side inside a unit."""
        found = set()
        for unit in self.units:
            parts = re.findall(r"(\w)([?*+]?)", unit)
            for k, (name, times) in enumerate(parts):
                if times in ("*", "+"):
                    found.add(name + name)
                for after, many in parts[k + 1 :]:
                    found.add(name + after)
                    if many not in ("?", "*"):
                        break
        return found

    def boundary(self) -> str:
        """A regular expression of the places between units."""
        inside, places = self.neighbours(), []
        for before, body in self.classes:
            after = [f"[{other}]" for name, other in self.classes if before + name not in inside]
            if after:
                places.append(f"(?<=[{body}])(?={'|'.join(after)})")
        return "|".join(places)


SPACE = r"\x20\x09-\x0D"
#: A word with the white space before it; white space at the end of a text is a unit.
WORDS = Grammar((("s", SPACE), ("w", "^" + SPACE)), ("s*w+", "s+"))
#: A line with its end.
LINES = Grammar((("n", r"\n"), ("x", r"^\n")), ("x*n", "x+"))
#: A code point.
CHARACTERS = Grammar((("c", r"\x00-\x{10FFFF}"),), ("c",))
#: A run of letters, of digits, of white space, or one other character.
RUNS = Grammar((("l", r"\p{L}\p{M}"), ("d", r"\p{Nd}"), ("s", SPACE), ("o", r"^\p{L}\p{M}\p{Nd}" + SPACE)), ("l+", "d+", "s+", "o"))


def units(text: Column, grammar: Grammar = WORDS) -> Column:
    """The units of a text, which joined are the text; an empty or null text has none."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<string>")  # split would give an empty text one piece
    return F.when(text == "", none).otherwise(F.split(text, grammar.boundary(), -1))


def _draw(hashed: Column, k: int) -> Column:
    return F.conv(F.substring(hashed, 8 * k - 7, 8), 16, 10).cast("long")


def transformed(docs: DataFrame, grammar: Grammar = WORDS, seed: int = SEED, rate: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs (doc_id, text, ...) with the number of units n, form, prefix_chars, middle_chars and the output text.

    The draws depend on seed and doc_id alone (a null doc_id is drawn as an empty one), so repeated rows are transformed
    alike.  A null text counts as empty; empty texts, and texts that contain a sentinel, are plain: output is the
    text (empty for null), and the lengths are null.  Columns of docs that are named like a result are replaced; all others are kept.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS]
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    step = docs.select(*kept, F.struct(text.alias("text"), hashed.alias("h"), units(F.col("text"), grammar).alias("units")).alias("_fim"))
    h, n = F.col("_fim.h"), F.size("_fim.units").cast("long")
    first, second = _draw(h, 1) % (n + 1), _draw(h, 2) % (n + 1)
    marked = F.greatest(*[F.instr("_fim.text", mark) for mark in (PREFIX, SUFFIX, MIDDLE)]) > 0
    plain = (n == 0) | marked | (_draw(h, 3) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(h, 4) % 100 < suffix_first, "spm").otherwise("psm")
    names = [F.col(f"`{c}`") for c in step.columns if c != "_fim"]
    step = step.select(*names, "_fim", n.alias("n"), form.alias("form"), F.least(first, second).cast("int").alias("_fim_a"), F.greatest(first, second).cast("int").alias("_fim_b"))
    a, b = F.col("_fim_a"), F.col("_fim_b")
    part = lambda start, count: F.array_join(F.slice("_fim.units", start, count), "")
    parts = F.when(F.col("form") != "plain", F.struct(part(F.lit(1), a).alias("p"), part(a + 1, b - a).alias("m"), part(b + 1, F.col("n").cast("int") - b).alias("s")))
    step = step.select(*names, "n", "form", F.col("_fim.text").alias("_fim_text"), parts.alias("_fim_parts"))
    p, m, s = (F.col(f"_fim_parts.{x}") for x in "pms")
    ordered = F.when(F.col("form") == "plain", F.col("_fim_text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
    output = ordered.otherwise(F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
    return step.select(*names, "n", "form", F.char_length(p).cast("long").alias("prefix_chars"), F.char_length(m).cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of.

    Only texts without a sentinel are reordered, and no sentinel can overlap another, so that the first second mark ends the first part
    and the first third mark after it ends the second.
    """

    def parts(second: str) -> tuple[Column, Column, Column]:
        left = F.substring_index(F.substr(output, F.lit(4)), second, 1)
        after = F.substr(output, F.char_length(left) + 7)
        right = F.substring_index(after, MIDDLE, 1)
        return left, right, F.substr(after, F.char_length(right) + 4)

    p, s, m = parts(SUFFIX)
    s2, p2, m2 = parts(PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def op11_lookaround_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents in its form, by hashes of the output and of what is restored from it."""
    docs = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    hashes = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


#: The same in SQL, with the units by their own expression instead of by boundaries; what is restored is the text.
SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
 regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
e AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
  WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (SELECT doc_id, t, n, form, array_to_string(list_slice(u, 1, least(x, y)), '') AS p, array_to_string(list_slice(u, least(x, y) + 1, greatest(x, y)), '') AS m, array_to_string(list_slice(u, greatest(x, y) + 1, n), '') AS s FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""
