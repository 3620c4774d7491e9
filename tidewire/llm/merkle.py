"""Merkle manifest of a dataset: a tree of 16 children a node over each group's ordered leaves, and a proof for each leaf.

Leaves are sorted by range once.  A task knows the place of each of its rows in the row's group, because only the group that
a partition begins with can have rows in earlier ones: one number for each partition is enough.  Each task builds the
complete subtrees that are aligned in its rows; the ragged nodes between them are shuffled by their coordinates (group,
level, index), level by level, where 16 of them at most meet.  What stands above each local subtree then comes back down to it, and
proofs are made where the subtree's leaves are.  The groups' roots are the leaves of one more tree of the same kind.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import kernels as K

WIDTH = 16
#: Levels of the largest local subtree; its 4096 leaves are what a task holds at once.
LOCAL = 3
BLOCK = WIDTH**LOCAL
#: Levels that a tree can have: 2**60 leaves.
DEEPEST = 15
PATH = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*values: Column) -> Column:
    """The leaf of a row: a hash of its fields, each "-" if null, else its length in bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings on a path, joined, from the leaf's level up and from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def parents(nodes: list[str]) -> list[str]:
    """The nodes over a run of nodes that begins at a multiple of the width."""
    return [hashlib.sha256("".join(nodes[k : k + WIDTH]).encode()).hexdigest() for k in range(0, len(nodes), WIDTH)]


def depth(n: int) -> int:
    """Levels over n leaves."""
    return next(k for k in range(DEEPEST + 1) if WIDTH**k >= n)


def subtrees(first: int, n: int) -> list[tuple[int, int]]:
    """(level, leaves) of the largest aligned complete subtrees, in order, of n leaves from this index on."""
    out, at = [], first
    while at < first + n:
        level = max(k for k in range(LOCAL + 1) if at % WIDTH**k == 0 and at + WIDTH**k <= first + n)
        out.append((level, WIDTH**level))
        at += WIDTH**level
    return out


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to a sorted partition its number, the row's place among its group's rows here, and whether the group is the partition's first."""
    from pyspark import TaskContext

    part, group, place, first = TaskContext.get().partitionId(), None, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("g")
        changed = np.empty(batch.num_rows, bool)
        changed[0] = group is not None and own[0].as_py() != group
        changed[1:] = pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)
        at = np.arange(batch.num_rows)
        begins = np.maximum.accumulate(np.where(changed, at, -1))
        places = np.where(begins < 0, at + place, at - begins)
        firsts = first & (begins < 0)
        group, place, first = own[-1].as_py(), int(places[-1]) + 1, bool(firsts[-1])
        more = [pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(places, pa.int64()), pa.array(firsts)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "place", "first"])


def _offsets(sorted_rows: DataFrame) -> dict[int, int]:
    """How many rows of a partition's first group lie in earlier partitions; the driver gets a row for each partition."""
    ends = sorted_rows.groupBy("part").agg(F.min("g").alias("first"), F.max(F.struct("g", "place")).alias("last")).collect()
    out, last, rows = {}, None, 0
    for r in sorted(ends, key=lambda r: r.part):
        out[r.part] = rows if last == r["first"] else 0
        rows = r["last"].place + 1 + (out[r.part] if r["first"] == r["last"].g else 0)
        last = r["last"].g
    return out


def _built(offsets):
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Puts each leaf into its local subtree: level and top (the subtree's root), and at its first leaf the hash and n, its leaves.

        Rows of a file come in order; any break of the order only makes subtrees smaller.
        """
        before, waiting = offsets.value, deque()
        rows: deque[tuple] = deque()
        group, part, start, nodes = None, None, 0, []

        def close(ended: bool) -> None:
            if not nodes:
                return
            whole = ended and start == 0  # all of the group
            cuts, at = [(depth(len(nodes)), len(nodes))] if whole else subtrees(start, len(nodes)), 0
            for level, n in cuts:
                top = nodes[at : at + n]
                for _ in range(level):
                    top = parents(top)
                place = (start + at) // WIDTH**level
                rows.append((level, place, top[0], n))
                rows.extend([(level, place, None, None)] * (n - 1))
                at += n
            nodes.clear()

        def ready(all_of_them: bool) -> Iterator[pa.RecordBatch]:
            while waiting and (all_of_them or len(rows) >= waiting[0][0].num_rows):
                batch, index = waiting.popleft()
                own = list(zip(*[rows.popleft() for _ in range(batch.num_rows)]))
                more = [pa.array(x, t) for x, t in zip((index, *own), (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()))]
                kept = [k for k, c in enumerate(batch.schema.names) if c not in ("part", "place", "first")]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *more], [*(batch.schema.names[k] for k in kept), "idx", "level", "top", "hash", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("part").to_pylist()
            index = [p + before[k] if f else p for k, p, f in zip(parts, batch.column("place").to_pylist(), batch.column("first").to_pylist())]
            waiting.append((batch, index))
            for g, k, i, leaf in zip(batch.column("g").to_pylist(), parts, index, batch.column("leaf").to_pylist()):
                if g != group or i != start + len(nodes) or len(nodes) == BLOCK - start % BLOCK:
                    close(g != group and k == part)
                    group, start = g, i
                part = k
                nodes.append(leaf)
            yield from ready(False)
        close(False)
        yield from ready(True)

    return built


@dataclass(frozen=True)
class Tree:
    """Leaves with their local subtrees, each group's root, and for each upper level the runs of nodes under one parent."""

    leaves: DataFrame
    roots: DataFrame
    runs: list[DataFrame]
    payload: list[str]


def _schema(frame: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields), more])


def tree(leaves: DataFrame, order: list[str]) -> Tree:
    """The trees over leaves (g, leaf, the columns of order, payload): for each g its leaves ascend by order (nulls first), then by leaf.

    g and leaf aren't null.  Rows equal in all of these are taken in any order, which changes no node.
    """
    spark = leaves.sparkSession
    payload = [c for c in leaves.columns if c not in ("g", "leaf")]
    rows = K.kept(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    keys = [F.col("g"), *[F.col(c).asc_nulls_first() for c in order], F.col("leaf"), F.col("_row")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    places = K.kept(dealt.mapInArrow(_numbered, _schema(dealt, "part int, place long, first boolean")), "places")
    offsets = spark.sparkContext.broadcast(_offsets(places))
    plain = places.drop("part", "place", "first")
    built = K.kept(places.mapInArrow(_built(offsets), _schema(plain, "idx long, level int, top long, hash string, n long")), "subtrees")
    tops = built.where(F.col("hash").isNotNull()).select("g", "level", F.col("top").alias("idx"), "hash", "n")
    total = tops.groupBy("g").agg(F.sum("n").alias("total"))
    levels = sum((F.col("total") > WIDTH**k).cast("int") for k in range(DEEPEST + 1))
    nodes = K.kept(tops.join(total.select("g", levels.alias("depth")), "g").drop("n"), "nodes")
    roots, runs, made = nodes.where("level = depth").select("g", "depth", "hash"), [], None
    for level in range(nodes.agg(F.max("depth")).first()[0] or 0):
        here = nodes.where((F.col("level") == level) & (F.col("depth") > level)).select("g", "depth", "idx", "hash", F.lit(True).alias("is_top"))
        here = here.unionByName(made) if made is not None else here
        run = here.groupBy("g", "depth", F.expr(f"idx div {WIDTH}").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash", "is_top"))).alias("kids"))
        runs.append(K.kept(run, "runs"))
        over = runs[-1].select("g", "depth", F.col("parent").alias("idx"), F.sha2(F.array_join("kids.hash", ""), 256).alias("hash"), F.lit(False).alias("is_top"))
        roots = roots.unionByName(over.where(F.col("depth") == level + 1).select("g", "depth", "hash"))
        made = over.where(F.col("depth") > level + 1)
    return Tree(built, roots, runs, payload)


def _tops(found: Tree, above: DataFrame | None) -> DataFrame:
    """(g, level, top, path, subroot, root) for each local subtree: the siblings from its root up.

    above: (g, path, root), what stands over each group's root; None where the groups' roots are the end.
    """
    base = found.roots.withColumnRenamed("hash", "subroot")
    if above is None:
        base = base.withColumns({"path": F.array().cast(PATH), "root": F.col("subroot")})
    else:
        base = base.join(above, "g")
    base = K.kept(base, "bases")
    whole = found.leaves.where("hash IS NOT NULL").select("g", "level", F.col("top").alias("idx"))
    names = ["g", "level", "idx", "path", "subroot", "root"]
    # a group that is one local subtree: its root is the group's
    tops = [whole.join(base.withColumnRenamed("depth", "level"), ["g", "level"]).select(*names)]
    known = None
    for level in reversed(range(len(found.runs))):
        ends = base.where(F.col("depth") == level + 1).select("g", F.lit(0).cast("long").alias("parent"), "path", "subroot", "root")
        known = ends if known is None else ends.unionByName(known)
        kids = found.runs[level].select("g", "parent", "kids").join(known, ["g", "parent"]).select("g", "kids", F.posexplode("kids").alias("pos", "kid"), "path", "subroot", "root")
        joined = lambda start, count: F.array_join(F.slice("kids.hash", start, count), "")
        step = F.struct(joined(F.lit(1), F.col("pos")).alias("left"), joined(F.col("pos") + 2, F.size("kids")).alias("right"))
        kids = K.kept(kids.select("g", F.lit(level).alias("level"), F.col("kid.idx").alias("idx"), F.col("kid.is_top").alias("is_top"), F.concat(F.array(step), "path").alias("path"), "subroot", "root"), "paths")
        tops.append(kids.where("is_top").select(*names))
        known = kids.where("NOT is_top").select("g", F.col("idx").alias("parent"), "path", "subroot", "root")
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out.withColumnRenamed("idx", "top")


def paths_inside(leaves: list[str], level: int, above: list[dict]) -> list[list[dict]]:
    """The path of each leaf of a local subtree."""
    levels = [leaves]
    for _ in range(level):
        levels.append(parents(levels[-1]))
    over = [above]
    for nodes in reversed(levels[:-1]):
        here = []
        for k in range(0, len(nodes), WIDTH):
            run, up = nodes[k : k + WIDTH], over[k // WIDTH]
            here += [[{"left": "".join(run[:j]), "right": "".join(run[j + 1 :])}, *up] for j in range(len(run))]
        over = here
    return over


def _proven(columns: list[str], kind: pa.DataType):
    def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by subtree, its own row before its leaves: to each leaf its path, and the roots over it."""
        top, held, n = None, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            if held:
                own = pa.Table.from_batches(held)
                found = paths_inside(own.column("leaf").to_pylist(), top["level"], top["path"])
                more = [pa.array(found, kind), pa.array([top["subroot"]] * n, pa.string()), pa.array([top["root"]] * n, pa.string())]
                yield from pa.Table.from_arrays([*(own.column(c) for c in columns), *more], [*columns, "path", "subroot", "root"]).combine_chunks().to_batches(max_chunksize=512)
            held, n = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            tops = np.flatnonzero(pc.is_null(batch.column("leaf")).to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([-1, *tops], [*tops, batch.num_rows]):
                if a >= 0:
                    yield from close()
                    top = batch.slice(a, 1).select(["level", "path", "subroot", "root"]).to_pylist()[0]
                if b > a + 1:
                    held.append(batch.slice(a + 1, b - a - 1))
                    n += b - a - 1
        yield from close()

    return proven


def _paths(found: Tree, above: DataFrame | None) -> DataFrame:
    """(g, leaf, payload, path, subroot, root) for each leaf."""
    kept = ["g", "leaf", *found.payload]
    nothing = lambda frame, names: [F.lit(None).cast(frame.schema[c].dataType).alias(c) for c in names]
    tops = _tops(found, above)
    keys = ["g", "level", "top", "idx"]
    over = tops.select("g", "level", "top", F.lit(-1).cast("long").alias("idx"), *nothing(found.leaves, ["leaf", *found.payload]), "path", "subroot", "root")
    leaves = found.leaves.select(*keys, "leaf", *found.payload, *nothing(tops, ["path", "subroot", "root"]))
    dealt = over.unionByName(leaves).repartition("g", "level", "top").sortWithinPartitions(*keys)
    return dealt.mapInArrow(_proven(kept, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), _schema(found.leaves.select(*kept), f"path {PATH}, subroot string, root string"))


def group_key(group: Column) -> Column:
    """A key that is never null and sorts by bytes as the group does, null first."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("+"), group.cast("string")))


def manifest(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves with path (siblings from the leaf's level to the root of all), subroot (their group's root) and root.

    leaves: g, leaf, the columns of order and any others, none of which is called path, subroot or root.  A group of one leaf has it as its root,
    and a dataset of one group has the group's; paths hold a step for each level that is folded, empty where a run has one node.
    An empty table gives an empty one.
    """
    groups = tree(leaves, order)
    roots = groups.roots.select(F.lit("").alias("g"), F.col("hash").alias("leaf"), F.col("g").alias("group"))
    above = _paths(tree(roots, ["group"]), None)
    return _paths(groups, above.select(F.col("group").alias("g"), "path", "root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents as a leaf with what its proof gives; texts of every fifth are tampered with.

    Repeated rows are leaves of their own; a null doc_id comes first in its source and isn't tampered with.  Other columns are ignored.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    fields = [F.col(c) for c in FIELDS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, digest(*fields[:-1], F.translate("text", UPPER, LOWER)))
    rows = docs.select(group_key(F.col("source")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), digest(*fields).alias("leaf"), changed.alias("changed"))
    got = manifest(rows, ["doc_id"])
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int, top: int) -> str:
    """DuckDB SQL for the query: levels over each source's leaves and top levels over the sources, at least as many as there are."""
    leaf = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS[:-1]) + " || coalesce(strlen({0}) || ':' || {0}, '-'))"
    crc = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
    parts = [
        f"""d AS (SELECT doc_id, coalesce('+' || source, '') AS g, {leaf.format("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf.format(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents)""",
        "l0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS i, count(*) OVER (PARTITION BY g) AS total FROM d)",
        "s0 AS (SELECT g, i, total, leaf AS h FROM l0)",
    ]

    def climb(name: str, count: int) -> None:
        """Nodes of each level, and each node's siblings; a group's only node is left as it is."""
        for k in range(count):
            side = "string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN {})"
            parts.append(f"{name}w{k} AS (SELECT g, i, total, coalesce({side.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS a, coalesce({side.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS b FROM {name}{k})")
            parts.append(f"{name}{k + 1} AS (SELECT g, i // 16 AS i, (total + 15) // 16 AS total, CASE WHEN total = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY g, i // 16, total)")

    climb("s", levels)
    parts.append(f"r0 AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS total, h, g AS source FROM s{levels})")
    climb("r", top)
    parts.append(f"p0 AS (SELECT l0.*, r0.i AS j, r0.h AS subroot, r{top}.h AS root, '' AS proof, coalesce(changed, leaf) AS f FROM l0 JOIN r0 ON r0.source = l0.g CROSS JOIN r{top})")
    steps = [(f"sw{k}", "x.g = w.g AND x.i // {} = w.i".format(16**k)) for k in range(levels)] + [(f"rw{k}", "x.j // {} = w.i".format(16**k)) for k in range(top)]
    for k, (table, on) in enumerate(steps):
        parts.append(f"p{k + 1} AS (SELECT x.* EXCLUDE (proof, f), proof || w.a || w.b AS proof, CASE WHEN w.total > 1 THEN sha256(w.a || f || w.b) ELSE f END AS f FROM p{k} x JOIN {table} w ON {on})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM p{len(steps)}"


SQL = _sql(5, 3)
