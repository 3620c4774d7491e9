"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base kinds stand for themselves: assign (a password, secret, token or key with a value of six or more
characters), access (AKIA identifiers) and hex (24 or more hexadecimal digits).  Weak kinds, identifier, secret and
endpoint, are common in clean text; they are reported only where complementary parts start within a scope
of SCOPE characters: an identifier with a secret, a secret with an identifier or an endpoint, and an endpoint with
both.  Base finds take part: assign and hex as secrets, access as an identifier.

What belongs together is linked: each secret, a base find or a weak one, with the nearest identifier and the nearest endpoint in scope.

Starts are joined by scope-wide buckets.  Inside a bucket a window finds each part's nearest neighbours of each role; of the two
neighbouring buckets only the last and the first part of each role can be nearer, so that no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCOPE = 300
# Patterns of the base kinds.
ASSIGN = "(?:((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+))"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
WEAK = {
    "identifier": "(?i:client_?id|access_?key(?:_?id)?|user_?name|user|login|account_?id)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9@._-]{4,}",
    "secret": "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}|(?i:pwd|passphrase|private_?key|credential)[\"']?\\x20*[:=]\\x20*[\"']?[^\\s\"']{6,}",
    "endpoint": "[a-z][a-z0-9+.-]{1,20}://[^\\s\"'<>]{4,}",
}
KINDS = (*BASE, *WEAK)
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret"}
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"
ROLES = ("identifier", "secret", "endpoint")
#: Matches that are placed at once: a text of very many costs about their number to the power 1.5.
CHUNK = 64


def _let(value: Column, body) -> Column:
    """body of a value that is computed once; a column that is named twice in higher-order functions would be computed twice."""
    return F.transform(F.array(value), body)[0]


def _found(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Spans of leftmost matches that don't overlap, in code points; those whose group is shorter than least are left out.

    The gaps between matches are what split() leaves, so that their lengths place the matches.
    """
    wholes = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.split(text, pattern, -1), wholes, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), (F.length(F.regexp_extract(m, pattern, group)) if group else F.length(m)).alias("part")))
    sizes = F.filter(sizes, lambda s: s["n"].isNotNull())
    zero = F.lit(0).cast("long")

    def in_chunks(sizes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda k: F.slice(sizes, k * CHUNK + 1, CHUNK))

    def starts_of(chunks: Column) -> Column:
        lengths = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda acc, s: acc + s["gap"] + s["n"]))
        return F.aggregate(lengths, F.array(zero), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    none = F.array().cast(f"array<{SPAN}>")

    def placed(chunk: Column, start: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            at = acc["at"] + s["gap"]
            span = F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (at + s["n"]).alias("end"), F.lit(kind).alias("kind"))
            spans = F.when(s["part"] >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).cast(f"array<{SPAN}>")
            return F.struct((at + s["n"]).cast("long").alias("at"), spans.alias("spans"))

        return F.aggregate(chunk, F.struct(start.cast("long").alias("at"), none.alias("spans")), step)["spans"]

    def all_placed(chunks: Column) -> Column:
        return F.flatten(F.zip_with(chunks, F.slice(starts_of(chunks), 1, F.size(chunks)), placed))

    spans = _let(sizes, lambda sizes: _let(in_chunks(sizes), all_placed))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _base(text: Column) -> Column:
    return F.array_sort(F.concat(_found(text, ASSIGN, "assign", 2, 6), _found(text, ACCESS, "access"), _found(text, HEX, "hex")))


def _weak(text: Column, base: Column) -> Column:
    """Weak spans outside the base ones."""
    spans = F.concat(*(_found(text, p, k) for k, p in WEAK.items()))
    return F.filter(spans, lambda w: ~F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))


def _role(kind: Column) -> Column:
    return F.when(kind.isin("assign", "hex"), "secret").when(kind == "access", "identifier").otherwise(kind)


def _located(docs: DataFrame) -> DataFrame:
    """docs with __base, __weak (only where some complement is there too) and __key, the same for equal rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("__base", _base(text))
    out = out.withColumn("__weak", _weak(text, F.col("__base")))
    roles = F.array_distinct(F.transform(F.concat("__base", "__weak"), lambda s: _role(s["kind"])))
    out = out.withColumn("__several", F.size(roles) > 1)
    out = out.withColumn("__weak", F.when(F.col("__several"), F.col("__weak")).otherwise(F.array().cast(f"array<{SPAN}>")))
    return out.withColumn("__key", F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(text)))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(__key, __linked, __links) of rows (__key, __base, __weak): the weak spans with complementary parts in scope, and of each secret
    that has any a struct (secret, identifier, endpoint), null where there is none, the nearest by its start and then the earlier one.

    Keys without either are left out.
    """
    some = parts.where("__several").select("__key", "__base", "__weak").dropDuplicates(["__key"])
    spans = some.select("__key", F.explode(F.concat("__base", "__weak")).alias("s")).select("__key", "s", _role(F.col("s.kind")).alias("role"), F.floor(F.col("s.start") / scope).alias("bucket"))
    own = lambda r: F.when(F.col("role") == r, F.col("s"))
    edges = spans.groupBy("__key", "bucket").agg(*(f(own(r)).alias(f"{name}_{r}") for r in ROLES for name, f in (("first", F.min), ("last", F.max))))
    # what a bucket lends to the next one and to the one before
    lent = edges.select("__key", (F.col("bucket") + 1).alias("bucket"), *(F.col(f"last_{r}").alias(f"before_{r}") for r in ROLES), *(F.lit(None).cast(SPAN).alias(f"after_{r}") for r in ROLES))
    lent = lent.unionByName(edges.select("__key", (F.col("bucket") - 1).alias("bucket"), *(F.lit(None).cast(SPAN).alias(f"before_{r}") for r in ROLES), *(F.col(f"first_{r}").alias(f"after_{r}") for r in ROLES)))
    lent = lent.groupBy("__key", "bucket").agg(*(F.max(f"{name}_{r}").alias(f"{name}_{r}") for name in ("before", "after") for r in ROLES))
    inside = Window.partitionBy("__key", "bucket").orderBy("s")  # at most as wide as the scope
    up, down = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    met = spans.select("__key", "bucket", "s", "role", *(f(own(r)).over(w).alias(f"{name}_{r}") for r in ROLES for name, f, w in (("up", F.max, up), ("down", F.min, down))))
    met = met.join(lent, ["__key", "bucket"], "left")

    def nearest(r: str) -> Column:
        found = F.array(*(F.col(f"{name}_{r}") for name in ("up", "down", "before", "after")))
        away = lambda c: F.abs(c["start"] - F.col("s.start"))
        near = F.filter(found, lambda c: c.isNotNull() & (away(c) <= scope))
        return F.array_min(F.transform(near, lambda c: F.struct(away(c).alias("away"), c.alias("span"))))["span"]

    met = met.select("__key", "s", "role", *(nearest(r).alias(r) for r in ROLES))
    i, x, e = (F.col(r).isNotNull() for r in ROLES)
    weak = ~F.col("s.kind").isin(*BASE)
    good = weak & F.when(F.col("role") == "identifier", x).when(F.col("role") == "secret", i | e).otherwise(i & x)
    link = F.when((F.col("role") == "secret") & (i | e), F.struct(F.col("s").alias("secret"), "identifier", "endpoint"))
    out = met.groupBy("__key").agg(F.collect_list(F.when(good, F.col("s"))).alias("__linked"), F.collect_list(link).alias("__links"))
    return out.where((F.size("__linked") > 0) | (F.size("__links") > 0))


def _described(links: Column) -> Column:
    """Each link as identifier+secret+endpoint@distance, where a part is kind:start:end or -, and the distance is that from its first to its last start."""
    part = lambda s: F.when(s.isNull(), "-").otherwise(F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))

    def one(x: Column) -> Column:
        starts = [x[r]["start"] for r in ROLES]
        apart = F.greatest(*starts) - F.least(*starts)
        return F.concat(F.concat_ws("+", *(part(x[r]) for r in ROLES)), F.lit("@"), apart.cast("string"))

    return F.array_join(F.transform(F.array_sort(links), one), ",")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked (weak spans), links and n_links.

    Null texts count as empty, and have no spans.  One row per input row; repeated rows get equal results,
    null ids too; other columns are ignored.  Spans are kind:start:end in code points by start, then kind; links are described by the secret's start.
    """
    from tidewire.llm.kernels import kept

    parts = kept(_located(docs.select("doc_id", "text")).drop("text"), "parts")
    both = parts.join(linked(parts, scope), "__key", "left")
    weak, links = F.coalesce("__linked", F.array().cast(f"array<{SPAN}>")), F.coalesce("__links", F.array().cast(f"array<struct<secret:{SPAN},identifier:{SPAN},endpoint:{SPAN}>>"))
    counts = [_count(k).alias(f"n_{k}") for k in BASE]
    more = [F.size(weak).cast("long").alias("n_linked"), _described(links).alias("links"), F.size(links).cast("long").alias("n_links")]
    return both.select("doc_id", *counts, F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("__base", weak))).alias("spans"), *more)


def redacted(docs: DataFrame, mark: str = "[REDACTED]", scope: int = SCOPE) -> DataFrame:
    """docs with every span of the scan replaced by mark; spans that overlap are one.

    Rows without a span pass unchanged, null texts too; n_chars, where docs has it, follows a changed text.  Other columns pass,
    whatever their names.  Each text is located once.
    """
    from tidewire.llm.kernels import kept

    columns = docs.columns
    located = kept(_located(docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), "doc_id", "text")), "located")
    none = F.array().cast(f"array<{SPAN}>")
    plain = located.where(F.size("__weak") == 0).withColumn("__linked", none)
    rare = located.where(F.size("__weak") > 0)
    rare = rare.join(linked(rare, scope).drop("__links"), "__key", "left").withColumn("__linked", F.coalesce("__linked", none))
    both = plain.unionByName(rare).withColumn("__spans", F.array_sort(F.concat("__base", "__linked")))
    text = F.col("text")
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate("__spans", first, step, lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text))))
    changed = F.size("__spans") > 0
    out = []
    for c in columns:
        if c == "text":
            out.append(F.when(changed, folded).otherwise(text).alias("text"))
        elif c == "n_chars":
            out.append(F.when(changed, F.length(folded)).otherwise(F.col("__row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            out.append(F.col(f"__row.`{c}`"))
    return both.select(*out)


def op8_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secret spans of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
