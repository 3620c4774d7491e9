"""Snapshots of items, of a crawl's metadata and of repositories, and a generator of sample items."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewire.sources import versions

META = "fetched_at string, count long, sources map<string, long>, errors map<string, string>"


def _missing(e: Exception) -> bool:
    return isinstance(e, PySparkException) and e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_items(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The items of a JSON file, an array or an object with an array `items`; none if there is no such file, or it can't be read."""
    kind = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">")
    try:
        raw = spark.read.option("wholetext", True).text(path)
    except PySparkException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], schema)
    array, inner = F.from_json("value", f"array<struct<{kind}>>"), F.from_json("value", f"struct<items: array<struct<{kind}>>>")
    # an object parsed as an array gives one row of it, so that its first character decides
    chosen = F.when(F.ltrim("value").startswith("["), array).otherwise(inner["items"])
    return raw.select(F.inline(chosen))


def stamped(items: DataFrame, now: str) -> DataFrame:
    """items with fetched_at, where they lack it now."""
    return items.withColumn("fetched_at", F.coalesce("fetched_at", F.lit(now)) if "fetched_at" in items.columns else F.lit(now))


def meta_of(items: DataFrame, now: str | None = None, errors: DataFrame | None = None) -> DataFrame:
    """One row of META: the items' count and those of each source, and errors (source, error), 200 characters each."""
    each = items.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    row = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"))
    if errors is None:
        failed = row.select(F.create_map().cast("map<string,string>").alias("errors")).limit(1)
    else:
        failed = errors.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", F.substring("error", 1, 200))))).alias("errors"))
    return row.join(failed).select(F.lit(now).cast("string").alias("fetched_at"), "count", "sources", "errors")


def write_snapshot(items: DataFrame, path: str, now: str, errors: DataFrame | None = None) -> None:
    """Commits stamped items and their metadata as the snapshot under path; what was there stays readable until then."""
    spark, at, folder = items.sparkSession, versions.last(items.sparkSession, path), versions.aside(path, "snapshot")
    stamped(items, now).write.parquet(f"{folder}/items")
    meta_of(spark.read.parquet(f"{folder}/items"), now, errors).write.json(f"{folder}/meta")
    versions.commit(spark, path, {"items": [f"{folder}/items"], "meta": [f"{folder}/meta"]}, {"fetched_at": now}, at)


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(items, meta) as of the last commit, or None if there is none."""
    at = versions.last(spark, path)
    if at is None:
        return None
    items = spark.read.parquet(*versions.paths(path, at, "items"))
    return items, read_meta(spark, versions.paths(path, at, "meta")[0], items)


def write_repos(repos: DataFrame, path: str, now: str) -> None:
    """Commits repositories and the row about them as the snapshot under path; started_at is the first snapshot's."""
    spark, at, folder = repos.sparkSession, versions.last(repos.sparkSession, path), versions.aside(path, "repos")
    started = at.values["started_at"] if at else now
    repos.write.parquet(f"{folder}/repos")
    about = repo_snapshot(spark.read.parquet(f"{folder}/repos"), now, spark.createDataFrame([(started,)], "started_at string"))
    about.write.json(f"{folder}/about")
    versions.commit(spark, path, {"repos": [f"{folder}/repos"], "about": [f"{folder}/about"]}, {"fetched_at": now, "started_at": started}, at)


def read_repos(spark: SparkSession, path: str) -> tuple[DataFrame, versions.Commit] | None:
    """(repositories, commit with fetched_at and started_at) as of the last commit, or None."""
    at = versions.last(spark, path)
    return (spark.read.parquet(*versions.paths(path, at, "repos")), at) if at else None


def read_repo_file(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row (fetched_at, started_at, repos: array of kind) of a JSON file; none if there is no file, it isn't JSON, or its `repos` is no array."""
    fields = f"fetched_at string, started_at string, repos array<struct<{kind}>>"
    try:
        raw = spark.read.option("wholetext", True).text(path)
    except PySparkException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], fields)
    value, get = F.col("value"), lambda *names: F.coalesce(*(F.get_json_object("value", f"$.{n}") for n in names))
    repos = F.get_json_object(value, "$.repos")
    rows = raw.where(F.json_array_length(repos).isNotNull())
    return rows.select(get("fetchedAt", "fetched_at").alias("fetched_at"), get("startedAt", "started_at").alias("started_at"), F.from_json(repos, f"array<struct<{kind}>>").alias("repos"))


def read_meta(spark: SparkSession, path: str, items: DataFrame) -> DataFrame:
    """One row of META from path, its gaps filled with defaults; where there is none, from the items, and no row if there are none."""
    try:
        found = spark.read.schema(META).json(path)
        return found.select("fetched_at", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("sources", F.create_map().cast("map<string,long>")).alias("sources"), F.coalesce("errors", F.create_map().cast("map<string,string>")).alias("errors"))
    except PySparkException as e:
        if not _missing(e):
            raise
    return items.agg(F.lit(None).cast("string").alias("fetched_at"), F.count(F.lit(1)).alias("count"), F.create_map().cast("map<string,long>").alias("sources"), F.create_map().cast("map<string,string>").alias("errors")).where("count > 0")


def read_archive(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All months of an archive; files that can't be read are skipped, and none give no rows."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(path)
    except PySparkException as e:
        if not _missing(e):
            raise
    return spark.createDataFrame([], schema)


def repo_snapshot(repos: DataFrame, now: str, previous: DataFrame | None = None) -> DataFrame:
    """One row (fetched_at, started_at, count, by_source) about a snapshot of repositories; started_at is that of the previous one, where there is one."""
    each = repos.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    row = each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source")).join(repos.agg(F.count(F.lit(1)).alias("count")))
    old = previous.agg(F.min("started_at").alias("old")) if previous is not None else row.select(F.lit(None).cast("string").alias("old"))
    return row.join(old).select(F.lit(now).alias("fetched_at"), F.coalesce("old", F.lit(now)).alias("started_at"), "count", "by_source")


def sample_items(ids: DataFrame, seeds: list[tuple[str, str, str]], sources: list[tuple[str, str]], now: str) -> DataFrame:
    """A sample item for each of ids (id long, from 0): seeds (title, summary, category) and sources (name, url) in turn, three hours apart, two of three selected."""
    pick = lambda values, k: F.get(F.array(*(F.struct(*map(F.lit, v)) for v in values)), (k % len(values)).cast("int"))
    i = F.col("id")
    rows = ids.select(i, pick(seeds, i).alias("seed"), pick(sources, i).alias("src"))
    turn = F.floor(i / len(seeds))
    title = F.when(turn > 0, F.concat("seed.col1", F.lit(" ("), (turn + 1).cast("string"), F.lit(")"))).otherwise(F.col("seed.col1"))
    at = F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(0), (i * 3).cast("int"))
    return rows.select(
        F.concat(F.lit("mock-"), F.lpad((i + 1).cast("string"), 4, "0")).alias("id"), title.alias("title"), F.col("seed.col2").alias("summary"), F.col("seed.col3").alias("category"), F.col("src.col1").alias("source"), F.col("src.col2").alias("source_url"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("published_at"), F.greatest(F.lit(25), 95 - i + ((i * 13 + 7) % 10)).cast("long").alias("heat"), (i % 3 != 0).alias("ai_selected"),
    )
