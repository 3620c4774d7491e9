"""The item view over the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item for each document: title is its first line, category, time and engagement come from its event, selection from its label, the URL from its page.

    Titles and lines are taken where texts are read, so that no join carries a text that isn't asked for.
    """
    docs, events, labels, pages = (table(spark, sf_dir, n) for n in ("documents", "events", "labels", "pages"))
    docs = docs.select("doc_id", F.split("text", "\n")[0].alias("title"), "text", F.size(F.split("text", "\n")).cast("long").alias("lines"), "lang", "source")
    pages = pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("source_url"))
    # files are a small part of what their rows take in memory: the planner would have the driver hold all events where few columns are asked for
    events, labels, pages = (t.hint("merge") for t in (events, labels, pages))
    out = docs.join(events, F.col("doc_id") == F.col("event_id")).join(labels, "doc_id", "left").join(pages, "doc_id", "left")
    return out.select(
        F.col("doc_id").alias("id"),
        "title",
        F.col("text").alias("summary"),
        "source",
        F.col("event_type").alias("category"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"),
        F.floor("value").cast("long").alias("engagement"),
        F.col("lang").alias("origin"),
        (F.col("quality") == 1).alias("ai_selected"),
        "source_url",
        "lines",
    )


def tagged_documents(spark: SparkSession, sf_dir: str, tags) -> DataFrame:
    """id, published_at and tags (a function of a text column) of the items.

    Texts become tags where they are read, so that no join carries them.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tags(F.col("text")).alias("tags"))
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"))
    return docs.join(times, "id")


def stream_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items from events alone: id, source, category, published_at and heat (the value's floor)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("category"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"), F.floor("value").cast("long").alias("heat")
    )


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star events of repositories: repo and day, from line items."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("repo"), F.to_date("l_shipdate").alias("day"))
