import hashlib
import random
import zlib

import pytest

from tidewire.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root, and for each node its siblings level by level, as (before, after)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, j in enumerate(at):
            run = level[j // 16 * 16 : j // 16 * 16 + 16]
            paths[k].append(("".join(run[: j % 16]), "".join(run[j % 16 + 1 :])))
        at = [j // 16 for j in at]
        level = [H(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], paths


def brute(rows):
    groups = {}
    for doc_id, text, lang, source, n in rows:
        own = leaf((doc_id, source, lang, n, text))
        lower = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        tampered = leaf((doc_id, source, lang, n, lower)) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else None
        groups.setdefault(source, []).append((doc_id is not None, doc_id, own, tampered))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(groups[s], key=lambda r: (r[0], r[1] or 0, r[2])),) for s in sources}
    trees = {s: (own, *climb([r[2] for r in own])) for s, (own,) in trees.items()}
    root, above = climb([trees[s][1] for s in sources])
    out = []
    for s, over in zip(sources, above):
        own, subroot, paths = trees[s]
        for (_, doc_id, node, tampered), path in zip(own, paths):
            fold = tampered or node
            for a, b in [*path, *over]:
                fold = H(a, fold, b)
            out.append((doc_id, node, subroot, root, H(*(a + b for a, b in [*path, *over])), fold, fold == root))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, path int, part string"


def run(spark, tmp_path, rows, parts):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    docs.repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    got = M.op12_merkle_manifest(spark, str(tmp_path)).collect()
    return sorted(map(tuple, got), key=str)


def made(n, sources, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(k, pick("Some Text", "é🎉", "", None, "ABC" * 30), pick("en", None), sources(rng), pick(7, None)) for k in range(n)]


@pytest.mark.parametrize("n,parts", [(1, 1), (2, 1), (16, 2), (17, 3), (300, 7), (5000, 5)])
def test_one_source(spark, tmp_path, n, parts):
    rows = made(n, lambda rng: "s", n)
    assert run(spark, tmp_path, rows, parts) == sorted(brute(rows), key=str)


def test_a_hot_source_among_many_small_ones(spark, tmp_path):
    rows = made(9000, lambda rng: None if rng.random() < 0.02 else "hot" if rng.random() < 0.6 else f"é{rng.randrange(700)}", 5)
    rows += [rows[3]] * 40 + [(None, "Null ID", "en", "hot", 1)] * 20 + [(None, f"other {k}", None, None, None) for k in range(20)] + [(11, "Same id", "en", "hot", k) for k in range(30)]
    want = brute(rows)
    assert {r[-1] for r in want} == {True, False}
    assert run(spark, tmp_path, rows, 6) == sorted(want, key=str)


def test_local_subtrees():
    assert M.subtrees(0, 16) == [(1, 16)] and M.subtrees(15, 18) == [(0, 1), (1, 16), (0, 1)]
    assert M.subtrees(256 - 16, 16 + 256 + 3) == [(1, 16), (2, 256), (0, 1), (0, 1), (0, 1)]
    assert [M.depth(n) for n in (1, 2, 16, 17, 256, 257)] == [0, 1, 1, 2, 2, 3]


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, [], 1) == []


def test_very_long_text(spark, tmp_path):
    rows = [(5, "Long é " * 500_000, "en", "s", 1), (6, None, None, None, None)]
    assert run(spark, tmp_path, rows, 1) == sorted(brute(rows), key=str)
