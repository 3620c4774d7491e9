import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewire.llm import fill_middle as M

PATTERNS = {
    "WORDS": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+",
    "LINES": r"[^\n]*\n|[^\n]+",
    "CHARACTERS": r"(?s:.)",
}
TEXTS = [None, "", " ", "a", "  a", "a  ", " a b\n\nc ", " x y", "\x1c \x1fz\x0b\x0c", "é 日本語 🎉🎉 x🎉", "🎉 🎉", "a\r\nb\n", "<P>", "x <S> y", "< P> <<M", "<M", "S>", "\n", "\x85q r"]


def rows():
    rng = random.Random(7)
    made = ["".join(rng.choice("ab é🎉\n\t<PSM>") for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    long = "".join(rng.choice(["word ", "é", "\n", " ", "日本"]) for _ in range(400_000))
    return list(enumerate([*TEXTS, *made, long])) + [(None, "no id here"), (None, None), (25, "again and again"), (25, "again and again")]


def brute(doc_id, text):
    text = text or ""
    pieces = re.findall(PATTERNS["WORDS"], text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(pieces)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(pieces[:a]), "".join(pieces[a:b]), "".join(pieces[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_forms_lengths_and_restored_texts(spark):
    made = rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in made], "doc_id long, text string, form string, `a.b` int")
    got = M.transformed(docs).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted(((i, t, *brute(i, t)) for i, t in made), key=str)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"} and "a.b" in got[0].asDict()


@pytest.mark.parametrize("name", list(PATTERNS))
def test_units_are_those_of_the_grammar(spark, name):
    made = [t for _, t in rows()][:-5]
    got = spark.createDataFrame([(t,) for t in made], "text string").select("text", M.units(F.col("text"), getattr(M, name)).alias("u")).collect()
    assert all(r.u == re.findall(PATTERNS[name], r.text or "") for r in got)


def test_runs_of_letters_and_digits(spark):
    got = spark.createDataFrame([("ab12  é--x",)], "text string").select(M.units(F.col("text"), M.RUNS)).first()[0]
    assert got == ["ab", "12", "  ", "é", "-", "-", "x"]


def test_translation():
    assert M.WORDS.boundary() == r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    with pytest.raises(ValueError, match="neighbouring"):
        M.Grammar((("s", " "), ("w", "^ ")), ("s?w+", "s+"))


def test_empty_table(spark):
    assert M.transformed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
