"""Feed documents as a Spark data source: a partition for each feed, filters on its id pushed down, and error rows for what fails.

    documents(spark, folder).where("feed like 'rss:open%'")

Options of the format feed_documents: path, a folder or URI that every executor can open; registry, a JSON array of feeds (feed, source, and category, tier, ai_only, strip_source
where they are known), by default the registry's; pattern, the name of a feed's document under path, with {name} for what follows the colon of
its id; only, ids or their beginnings, separated by commas; max_bytes, beyond which a document is an error.
A document may be a folder: its files in order are its parts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from tidewire.lineage import cut
from tidewire.sources.feed_registry import FEEDS, PREFIX, chosen
from tidewire.sources.feeds import feed_items

NAME = "feed_documents"
SCHEMA = "feed string, source string, category string, tier int, ai_only boolean, strip_source boolean, body string, error string"
ROOTS = {"rss", "feed", "RDF"}
LONGEST_ERROR, MAX_BYTES = 200, 64 << 20
DECLARED = re.compile(rb"^\s*<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)[\"'][^>]*\?>")


class NoFeed(ValueError):
    """A document that isn't a feed."""


@dataclass
class Feed(InputPartition):
    """One feed, and where its document is."""

    row: dict
    path: str


def _fetched(path: str, most: int) -> bytes:
    """The bytes of a file, or of a folder's files in order; hidden ones and marks of writers are left out."""
    if "://" in path:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        info = store.get_file_info(at)
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(at))) if info.type == fs.FileType.Directory else [at]
        opened = store.open_input_stream
    else:
        found = sorted(os.path.join(path, f) for f in os.listdir(path)) if os.path.isdir(path) else [path]
        opened = lambda p: open(p, "rb")
    parts, size = [], 0
    for name in found:
        if len(found) > 1 and os.path.basename(name)[:1] in "._":
            continue
        with opened(name) as file:
            parts.append(file.read(most + 1 - size))
        size += len(parts[-1])
        if size > most:
            raise NoFeed(f"more than {most} bytes")
    return b"".join(parts)


def checked(data: bytes) -> str:
    """A feed's text; NoFeed or a parser's error if it isn't well formed or not a feed."""
    roots: list[str] = []

    def first(name: str, _: dict) -> None:
        if not roots:
            roots.append(name.split(":")[-1])

    parser = expat.ParserCreate()
    parser.StartElementHandler = first
    parser.Parse(data, True)
    if roots[0] not in ROOTS:
        raise NoFeed(f"<{roots[0]}> isn't a feed")
    declared = DECLARED.match(data)
    text = data.decode(declared[1].decode() if declared else "utf-8", "replace")
    return re.sub(r"^\s*<\?xml.*?\?>", "", text.lstrip("﻿"), flags=re.S)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.pattern = options.get("pattern", "{name}.xml")
        self.most = int(options.get("max_bytes", MAX_BYTES))
        given = options.get("registry")
        self.feeds = json.loads(given) if given else [dict(zip(("feed", "source", "category", "tier", "ai_only", "strip_source"), (PREFIX + f[0], *f[2:]))) for f in FEEDS]
        only = [o.strip() for o in options.get("only", "").split(",") if o.strip()]
        self.only = only
        self.starts: list[str] = []
        self.equal: list[list[str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes what decides by feed alone; the rest is Spark's."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("feed",):
                self.starts.append(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("feed",):
                self.equal.append([f.value])
            elif isinstance(f, In) and f.attribute == ("feed",):
                self.equal.append(list(f.value))
            else:
                yield f

    def partitions(self) -> list[Feed]:
        found = []
        for row in self.feeds:
            feed = row["feed"]
            if chosen(feed, self.only) and all(feed.startswith(s) for s in self.starts) and all(feed in e for e in self.equal):
                found.append(Feed(row, f"{self.path}/{self.pattern.format(name=feed.split(':')[-1])}"))
        return found

    def read(self, partition: Feed) -> Iterator[tuple]:
        if partition is None:  # Spark reads one partition even where there is none
            return
        row, body, error = partition.row, None, None
        try:
            body = checked(_fetched(partition.path, self.most))
        except (OSError, NoFeed, expat.ExpatError, LookupError) as e:
            # of this feed alone: the others go on
            error = ("no document" if isinstance(e, FileNotFoundError) else str(e))[:LONGEST_ERROR]
        yield (row["feed"], row["source"], row.get("category"), row.get("tier"), bool(row.get("ai_only")), bool(row.get("strip_source")), body, error)


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:  # noqa: ANN001
        return FeedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets filters be pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)


def documents(spark: SparkSession, path: str, only: list[str] | None = None, **options: str) -> DataFrame:
    """(SCHEMA) of the feeds under path.

    A frame that is loaded keeps what a filter has pushed to it until another one is pushed, so that its next use without any
    would see too few feeds; the filter here, which every feed passes, makes each use push its own.
    """
    register(spark)
    reader = spark.read.format(NAME).option("path", path).options(**options)
    return (reader.option("only", ",".join(only)) if only else reader).load().where("feed is not null")


def crawled(docs: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(items, report) of documents, which are fetched once.

    report has a row (feed, source, n, error) for every feed, n being its items; failed ones have none and an error.
    """
    docs = cut(docs)
    items = feed_items(docs.where("error is null"), limit)
    counts = items.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))
    report = docs.select("feed", "source", "error").join(counts, docs.feed == counts.origin, "left").select("feed", "source", F.coalesce("n", F.lit(0)).alias("n"), "error")
    return items, report
