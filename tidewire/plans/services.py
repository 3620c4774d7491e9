"""Queries of what keeps state on disk or between rows: the search index, feeds as a source, admission, snapshots and retention."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import notes
from tidewire.lineage import shared_folder
from tidewire.operators import admission, classify, concepts, daily, fulltext, packing, search, weekly
from tidewire.plans.registry import query
from tidewire.plans.site import LOOSE, REPO_VIEW, loose, repo_view
from tidewire.sources import archive, exports, feed_source, snapshots, tables

# -- search

ASCII = "translate({0}, 'ñéèßêíçóöüä', 'ABCDEFGHIJK')"  # DuckDB's levenshtein counts bytes
RUNS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
ASKED = "SELECT DISTINCT conv_id AS qid, unnest(" + RUNS.format("array_to_string(regexp_extract_all(text, '[^ ]+')[1:3], ' ')") + ") AS term FROM conversations WHERE turn = 0"


def search_sql(items: str) -> str:
    """SQL for the best items of each conversation's first three words, over items (id, title, summary, source)."""
    field = lambda c, w: f"SELECT id, unnest({RUNS.format(c)}) AS word, CAST({w} AS DOUBLE) AS weight FROM items"
    return f"""WITH items AS ({items}), each AS (SELECT id, word, sum(weight) AS weight FROM ({field("title", 2)} UNION ALL {field("summary", 1)} UNION ALL {field("source", 1)}) GROUP BY id, word),
df AS (SELECT word, count(*) AS df, length(word) AS n, {ASCII.format("word")} AS plain FROM each GROUP BY word), q AS ({ASKED}),
t AS (SELECT DISTINCT term, length(term) AS m, CAST(round(length(term) * 0.2) AS INTEGER) AS d, {ASCII.format("term")} AS plain FROM q),
near AS (SELECT term, word, df, CASE WHEN word = term THEN CAST(1 AS DOUBLE) WHEN starts_with(word, term) THEN CAST(0.375 AS DOUBLE) * m / n ELSE CAST(0.45 AS DOUBLE) * m / (m + levenshtein(df.plain, t.plain)) END AS close
FROM t, df WHERE starts_with(word, term) OR (d > 0 AND abs(n - m) <= d AND levenshtein(df.plain, t.plain) <= d)),
hits AS (SELECT term, id, sum(weight / (weight + 1.2) * (close * ln(1 + ((SELECT count(*) FROM items) - df + 0.5) / (df + 0.5)))) AS value FROM near JOIN each USING (word) GROUP BY term, id),
s AS (SELECT qid, id, round(sum(value), 6) AS score FROM q JOIN hits USING (term) GROUP BY qid, id)
SELECT qid, id, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS place FROM s) WHERE place <= 8"""


def texts(spark, d):
    return tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("summary"), "source")


def asked(spark, d):
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)), 1, 3), " ")
    return tables.table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("qid"), first.alias("query"))


DOCUMENTS = "SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS summary, source FROM documents"


@query("index_search", search_sql(DOCUMENTS))
def index_search(spark, d):
    path = shared_folder(spark, "index")
    fulltext.build(texts(spark, d), path)
    return fulltext.found(spark, path, asked(spark, d))


@query("index_updated", search_sql(f"SELECT id, title, CASE WHEN id % 3 = 0 THEN summary END AS summary, source FROM ({DOCUMENTS}) WHERE id % 3 = 0 OR (id % 2 = 0 AND id % 7 <> 0)"))
def index_updated(spark, d):
    path, rows = shared_folder(spark, "index"), texts(spark, d)
    fulltext.build(rows.where("id % 2 = 0").withColumn("summary", F.lit(None).cast("string")), path)
    fulltext.update(rows.where("id % 3 = 0"), path, rows.where("id % 7 = 0").select("id"))
    return fulltext.found(spark, path, asked(spark, d))


@query("index_compacted", search_sql(f"SELECT id, title, summary, source FROM ({DOCUMENTS}) WHERE id % 5 <> 0"))
def index_compacted(spark, d):
    path, rows = shared_folder(spark, "index"), texts(spark, d)
    fulltext.build(rows.where("id % 2 = 0"), path)
    fulltext.update(rows.where("id % 2 = 1"), path, rows.where("id % 5 = 0").select("id"))
    fulltext.update(rows.where("false"), path, rows.where("id % 5 = 0").select("id"))
    fulltext.compact(spark, path)
    return fulltext.found(spark, path, asked(spark, d))


# -- feeds as a source

FEED_NAMES = [f"src{k}" for k in range(20)] + ["ghost"]
TITLES = "trim(regexp_replace(split_part(text, chr(10), 1), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'))"
LISTED = f"e AS (SELECT source, doc_id, {TITLES} AS title, 'https://feed.example/' || CAST(doc_id AS VARCHAR) AS link, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ord FROM documents), i AS (SELECT * FROM e WHERE ord < 20 AND title <> '' AND source <> 'src3')"


def written_feeds(spark, d) -> str:
    """A folder with a feed of each source's first 30 documents; that of src3 breaks off."""
    docs = tables.table(spark, d, "documents")
    title = F.trim(F.regexp_replace(F.split("text", "\n")[0], "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""))
    safe = F.replace(F.replace(F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    entry = F.concat(F.lit("<item><title>"), safe, F.lit("</title><link>https://feed.example/"), F.col("doc_id").cast("string"), F.lit("</link></item>"))
    first = docs.select("source", "doc_id", entry.alias("entry"), nth.alias("nth")).where("nth <= 30")
    body = first.groupBy(F.col("source").alias("feed")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "entry"))), lambda x: x["entry"]), "\n").alias("entries"))
    whole = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<rss><channel>'), "entries", F.lit("</channel></rss>"))
    path = shared_folder(spark, "feeds")
    body.select("feed", F.when(F.col("feed") == "src3", F.substring(whole, 1, 200)).otherwise(whole).alias("value")).write.partitionBy("feed").text(path)
    return path


def fetched(spark, d, **options):
    registry = json.dumps([{"feed": f"rss:{n}", "source": n.upper()} for n in FEED_NAMES])
    return feed_source.documents(spark, written_feeds(spark, d), registry=registry, pattern="feed={name}", **options)


@query("feed_fan_out", f"WITH {LISTED}, f AS (SELECT unnest({FEED_NAMES}) AS name) SELECT 'rss:' || name AS feed, upper(name) AS source, (SELECT count(*) FROM i WHERE i.source = name) AS n, name IN ('ghost', 'src3') AS failed FROM f")
def feed_fan_out(spark, d):
    _, report = feed_source.crawled(fetched(spark, d))
    return report.select("feed", "source", "n", F.col("error").isNotNull().alias("failed"))


@query("feed_adapters", f"WITH {LISTED} SELECT 'rss:' || source || '-' || substr(sha1(link), 1, 10) AS id, upper(source) AS source, ord, title, link AS source_url FROM i WHERE source LIKE 'src1%' OR source = 'src5'")
def feed_adapters(spark, d):
    items, _ = feed_source.crawled(fetched(spark, d, only=["rss:src1", "rss:src5"]))
    return items.select("id", "source", "ord", "title", "source_url")


# -- admission


def admission_sql(origin: str, limit: int, seconds: int, where: str = "true") -> str:
    """One request after another, by recursion."""
    micros = seconds * 1_000_000
    return f"""WITH RECURSIVE e AS (SELECT event_id, {origin} AS origin, epoch_us(ts) AS micros, row_number() OVER (PARTITION BY {origin} ORDER BY ts, event_id) AS n FROM events WHERE {where}),
s AS (SELECT origin, n, event_id, 1 AS used, micros AS latest, TRUE AS admitted FROM e WHERE n = 1
UNION ALL SELECT e.origin, e.n, e.event_id, CASE WHEN e.micros - s.latest >= {micros} THEN 1 WHEN s.used >= {limit} THEN s.used ELSE s.used + 1 END, CASE WHEN e.micros - s.latest >= {micros} OR s.used < {limit} THEN e.micros ELSE s.latest END, e.micros - s.latest >= {micros} OR s.used < {limit} FROM s JOIN e ON e.origin = s.origin AND e.n = s.n + 1)
SELECT event_id AS id, admitted FROM s UNION ALL SELECT event_id, FALSE FROM events WHERE NOT ({where})"""


def requests(spark, d, origin: str):
    return tables.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col(origin).cast("string").alias("origin"), "ts")


@query("admission_users", admission_sql("user_id", 3, 86400, "user_id < 100"))
def admission_users(spark, d):
    return admission.admitted(requests(spark, d, "user_id"), 3, 86400, [f"{k}/" for k in range(100)]).select("id", "admitted")


@query("admission_types", admission_sql("event_type", 20, 3600))
def admission_types(spark, d):
    return admission.admitted(requests(spark, d, "event_type")).select("id", "admitted")


# -- snapshots, retention and backfill


@query("snapshot_versions", "SELECT doc_id AS id, source, CASE WHEN doc_id % 5 = 0 THEN 'before' ELSE 'later' END AS fetched_at, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS n FROM documents WHERE doc_id % 2 = 0")
def snapshot_versions(spark, d):
    path, docs = shared_folder(spark, "snapshot"), tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.when(F.col("doc_id") % 5 == 0, "before").alias("fetched_at"))
    snapshots.write_snapshot(docs.where("id % 2 = 1"), path, "first")
    snapshots.write_snapshot(docs.where("id % 2 = 0"), path, "later")
    items, meta = snapshots.read_snapshot(spark, path)
    return items.join(F.broadcast(meta.select(F.col("count").alias("n"))))  # one row


@query("repos_written", f"WITH {REPO_VIEW} SELECT full_name, stars, 'now' AS fetched_at, 'first' AS started_at FROM repos WHERE stars % 2 = 0")
def repos_written(spark, d):
    path, rows = shared_folder(spark, "repos"), repo_view(spark, d)
    snapshots.write_repos(rows, path, "first")
    snapshots.write_repos(rows.where("stars % 2 = 0"), path, "now")
    found, at = snapshots.read_repos(spark, path)
    return found.select("full_name", "stars", F.lit(at.values["fetched_at"]).alias("fetched_at"), F.lit(at.values["started_at"]).alias("started_at"))


def archived_orders(spark, d) -> str:
    path = shared_folder(spark, "archive")
    rows = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("").alias("first_seen"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at"), F.concat(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 50 == 0, " (#3)").otherwise("")).alias("note"))
    archive.write_archive(spark, rows.where("published_at >= '1997-06-01'").repartition("published_at"), path)
    return path


@query("archive_expired", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, FALSE AS gone FROM orders WHERE o_orderdate >= TIMESTAMP '1998-04-01' GROUP BY 1 UNION ALL SELECT DISTINCT strftime(o_orderdate, '%Y-%m'), NULL, TRUE FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' AND o_orderdate < TIMESTAMP '1998-04-01'")
def archive_expired(spark, d):
    path = archived_orders(spark, d)
    gone = archive.expire(spark, path, "1998-06-15")
    left = spark.read.parquet(path).groupBy("month").agg(F.count(F.lit(1)).alias("n")).withColumn("gone", F.lit(False))
    return left.unionByName(spark.createDataFrame([(m, None, True) for m, *_ in gone + archive.expire(spark, path, "1998-06-15")], "month string, n long, gone boolean"))


@query("archive_rewritten", "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS id, o_orderpriority AS note FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'")
def archive_rewritten(spark, d):
    path = archived_orders(spark, d)
    archive.rewritten(spark, path, {"note": notes.without_marks(F.col("note"))})
    return spark.read.parquet(path).select("month", "id", "note")


@query("sanitize_reasons", f"WITH {LOOSE} SELECT count(*) AS n, count(*) FILTER (id IS NOT NULL AND trim(title) <> '' AND url <> 'javascript:x') AS kept, count(*) FILTER (id IS NULL) AS no_id, count(*) FILTER (id IS NOT NULL AND trim(title) = '') AS no_title, 0 AS no_source, count(*) FILTER (id IS NOT NULL AND trim(title) <> '' AND url = 'javascript:x') AS no_source_url FROM loose")
def sanitize_reasons(spark, d):
    rows, seen = classify.observed(loose(spark, d))
    rows.write.parquet(shared_folder(spark, "sanitised"))
    return spark.createDataFrame([seen.get])


NAMES = "names AS (SELECT p_partkey AS ord, p_brand || '/' || replace(p_name, ' ', '-') || repeat('x', CAST(p_partkey % 97 AS INTEGER)) || CAST(p_partkey AS VARCHAR) AS name FROM part)"


def named_parts(spark, d):
    k = F.col("p_partkey")
    return tables.table(spark, d, "part").select(k.alias("ord"), F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.repeat(F.lit("x"), (k % 97).cast("int")), k.cast("string")).alias("name"))


@query("request_packing", f"WITH RECURSIVE {NAMES}, e AS (SELECT *, length(name) + 6 AS w, row_number() OVER (ORDER BY ord, name) AS n FROM names), s AS (SELECT ord, name, n, w AS used, 1 AS request FROM e WHERE n = 1 UNION ALL SELECT e.ord, e.name, e.n, CASE WHEN s.used + e.w > 250 THEN e.w ELSE s.used + e.w END, CASE WHEN s.used + e.w > 250 THEN s.request + 1 ELSE s.request END FROM s JOIN e ON e.n = s.n + 1) SELECT request, string_agg('repo:' || name, ' ' ORDER BY n) AS query, count(*) AS n FROM s GROUP BY request")
def request_packing(spark, d):
    return packing.requests(packing.packed(named_parts(spark, d)))


# -- concepts

TERM_ROWS = ", ".join(f"({k}, '{c[0]}', '{t}')" for k, c in enumerate([*concepts.CONCEPTS, *concepts.SOFT]) for t in c)
NOISE_LIST = ", ".join(f"'{t}'" for t in concepts.NOISE)


@query("query_concepts", f"WITH terms(k, head, term) AS (VALUES {TERM_ROWS}), q AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.+#-]*')) AS token, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.+#-]*'), 1) AS pos FROM conversations), d AS (SELECT DISTINCT token FROM q WHERE token NOT IN ({NOISE_LIST})), g AS (SELECT token, coalesce(arg_min(head, k), token) AS head FROM d LEFT JOIN terms ON term = token OR (length(term) > 2 AND NOT regexp_matches(term, '[一-鿿]') AND starts_with(token, term)) GROUP BY token), f AS (SELECT conv_id, turn, head, min(pos) AS pos FROM q JOIN g USING (token) GROUP BY conv_id, turn, head) SELECT conv_id, turn, count(*) AS n, md5(string_agg(head, ' ' ORDER BY pos)) AS heads FROM f GROUP BY conv_id, turn")
def query_concepts(spark, d):
    asked = tables.table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("at"), F.col("text").alias("query"))
    found = concepts.segmented(asked.select(F.to_json("at").alias("qid"), "query"))
    each = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("k", F.col("terms")[0].alias("head")))).alias("heads"))
    at = F.from_json("qid", "conv_id long, turn long")
    return each.select(at["conv_id"].alias("conv_id"), at["turn"].alias("turn"), "n", F.md5(F.array_join(F.transform("heads", lambda x: x["head"]), " ")).alias("heads"))


@query("concept_queries", "WITH rows AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind FROM part), q AS (SELECT DISTINCT p_size AS qid, unnest(string_split(lower(min(p_name) OVER (PARTITION BY p_size) || ' ' || max(p_type) OVER (PARTITION BY p_size)), ' ')) AS token FROM part), h AS (SELECT token, id, CASE WHEN regexp_matches(lower(name), '(^|[^a-z0-9])' || token) THEN 5 ELSE 2 END AS weight FROM (SELECT DISTINCT token FROM q), rows WHERE regexp_matches(lower(name) || ' | ' || lower(kind), '(^|[^a-z0-9])' || token)), df AS (SELECT token, count(*) AS df FROM h GROUP BY token), ok AS (SELECT qid FROM q LEFT JOIN df USING (token) GROUP BY qid HAVING count(*) = count(df)), s AS (SELECT qid, id, round(sum(ln(1 + (SELECT count(*) FROM rows) / (1 + df)) * weight), 6) AS score FROM q JOIN ok USING (qid) JOIN df USING (token) JOIN h USING (token) GROUP BY qid, id) SELECT qid, id, score FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM s) WHERE score > 0 AND score >= 0.5 * top")
def concept_queries(spark, d):
    part = tables.table(spark, d, "part")
    asked = part.groupBy(F.col("p_size").alias("qid")).agg(F.concat_ws(" ", F.min("p_name"), F.max("p_type")).alias("query"))
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    return concepts.ranked(rows, concepts.segmented(asked, search.Dictionary([])), {"name": 5, "kind": 2})


# -- reports

NOTED = "noted AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS source, event_type AS category, event_type || CAST(event_id AS VARCHAR) AS title, CASE WHEN event_id % 40 = 0 THEN 'Note ' || CAST(event_id AS VARCHAR) || '。' END AS ai_note, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS published_at, strftime(ts, '%Y-%m-%d') AS day, CAST(floor(value) AS BIGINT) AS heat, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week FROM events)"
LABELS = {"view": "浏览", "purchase": "购买", "signup": "注册", "none": "无"}
SECTION = "coalesce((SELECT string_agg(CAST(id AS VARCHAR), ' ' ORDER BY heat DESC, id) FROM (SELECT *, row_number() OVER (ORDER BY heat DESC, id) AS k FROM noted x WHERE x.week = w.week AND category = '{0}') WHERE k <= 5), '')"
SECTION_NOTES = "coalesce((SELECT CASE WHEN count(ai_note) > 0 THEN array_to_string((array_agg(rtrim(ai_note) ORDER BY heat DESC, id) FILTER (ai_note IS NOT NULL))[1:2], '；') ELSE '本周{1}方向共 ' || count(*) || ' 条动态，重点包括：' || array_to_string((array_agg(title ORDER BY heat DESC, id))[1:3], '、') || '。' END FROM noted x WHERE x.week = w.week AND category = '{0}' HAVING count(*) > 0), '')"


def noted(spark, d):
    e = tables.table(spark, d, "events")
    key = F.col("event_id")
    return e.select(
        key.alias("id"), F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("category"), F.concat("event_type", key.cast("string")).alias("title"), F.when(key % 40 == 0, F.concat(F.lit("Note "), key.cast("string"), F.lit("。"))).alias("ai_note"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"), F.lit(None).cast("string").alias("first_seen"), F.floor("value").cast("long").alias("heat"),
    )


@query("weekly_reports", f"""WITH {NOTED}, w AS (SELECT week, count(*) AS n FROM noted WHERE week BETWEEN '2023-12-25' AND '2024-01-29' GROUP BY week),
c AS (SELECT *, row_number() OVER (PARTITION BY week, source ORDER BY heat DESC, id) AS k FROM noted), t AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY heat DESC, id) AS k2 FROM c WHERE k <= 4),
b AS (SELECT week, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY k2) AS top, array_agg(title ORDER BY k2) AS titles, array_agg(regexp_replace(ai_note, '[。；！？.;!?]+$', '') ORDER BY k2) FILTER (ai_note IS NOT NULL) AS notes FROM t WHERE k2 <= 10 GROUP BY week)
SELECT w.week, strftime(CAST(w.week AS DATE) + 6, '%Y-%m-%d') AS last, w.n, lag(w.n) OVER (ORDER BY w.week) AS previous, b.top,
{" || '|' || ".join(SECTION.format(c) for c in LABELS)} AS items, {" || '|' || ".join(SECTION_NOTES.format(c, x) for c, x in LABELS.items())} AS texts,
(SELECT string_agg(source || '=' || CAST(n AS VARCHAR), ' ' ORDER BY n DESC, source) FROM (SELECT source, count(*) AS n FROM noted x WHERE x.week = w.week GROUP BY source ORDER BY n DESC, source LIMIT 8)) AS sources,
(SELECT string_agg(CAST(n AS VARCHAR), ' ' ORDER BY day) FROM (SELECT strftime(CAST(w.week AS DATE) + CAST(i AS INTEGER), '%Y-%m-%d') AS day, (SELECT count(*) FROM noted x WHERE x.day = strftime(CAST(w.week AS DATE) + CAST(i AS INTEGER), '%Y-%m-%d')) AS n FROM range(7) r(i))) AS days,
{" || ' ' || ".join(f"CAST((SELECT count(*) FROM noted x WHERE x.week = w.week AND category = '{c}') AS VARCHAR)" for c in LABELS)} AS categories,
CASE WHEN len(b.notes) >= 2 THEN array_to_string(b.notes[1:3], '；') || '。' ELSE '本周共收录 ' || CAST(w.n AS VARCHAR) || ' 条资讯，热度最高的包括「' || array_to_string(b.titles[1:3], '」「') || '」。' END AS summary,
CASE WHEN w.week = '2024-01-15' THEN 'the insight' END AS insight FROM w JOIN b USING (week)""")
def weekly_reports(spark, d):
    insights = spark.createDataFrame([("2024-01-15 ~ 2024-01-21", "the insight"), ("2024-01-08 ~ 2024-01-14", "")], "label string, insight string")
    got = weekly.weekly_reports(noted(spark, d), "2024-01-31", LABELS, insights=insights)
    text = lambda c: c.cast("string")
    joined = lambda column, f, by=" ": F.array_join(F.transform(column, f), by)
    return got.select(
        "week", "last", "n", "previous", joined("top", text).alias("top"), joined("sections", lambda s: F.array_join(F.transform(s["section"]["items"], text), " "), "|").alias("items"), joined("sections", lambda s: s["section"]["summary"], "|").alias("texts"),
        joined("sources", lambda s: F.concat(s["source"], F.lit("="), text(s["n"]))).alias("sources"), joined("days", lambda s: text(s["n"])).alias("days"), joined("categories", lambda s: text(s["n"])).alias("categories"), "summary", "insight",
    )


@query("insight_listing", f"WITH {NOTED}, t AS (SELECT *, row_number() OVER (ORDER BY heat DESC, id) AS k FROM noted WHERE day BETWEEN '2024-01-15' AND '2024-01-21') SELECT (SELECT count(*) FROM t) AS n, string_agg(CAST(k AS VARCHAR) || '. 【' || source || '】' || title || coalesce(' — ' || ai_note, ''), chr(10) ORDER BY k) AS listing FROM t WHERE k <= 30")
def insight_listing(spark, d):
    return weekly.insight_listing(noted(spark, d), "2024-01-15", "2024-01-21")


@query("poster_sections", f"WITH {NOTED} SELECT k - 1 AS place, c AS category, coalesce((SELECT string_agg(CAST(id AS VARCHAR), ' ' ORDER BY heat DESC, id) FROM noted WHERE category = c AND day = '2024-01-20'), '') AS items FROM (SELECT unnest({list(LABELS)}) AS c, generate_subscripts({list(LABELS)}, 1) AS k)")
def poster_sections(spark, d):
    rows = noted(spark, d).withColumn("first_seen", F.col("published_at"))
    got = weekly.poster_sections(rows, "2024-01-20", list(LABELS))
    return got.select("place", "category", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"))


@query("daily_lead", f"WITH {NOTED} SELECT '2024-01-10' AS day, count(*) AS n, '2024-01-10 · AI 资讯日报' AS title, '今日新收录 ' || CAST(count(*) AS VARCHAR) || ' 条公开资讯，按模型 / 产品 / 行业 / 论文 / 观点 自动归类汇编（非 AI 生成，点击可溯源原文）。' AS paragraph FROM noted WHERE day = '2024-01-10'")
def daily_lead(spark, d):
    rows = noted(spark, d).withColumns({"first_seen": F.concat("published_at", F.lit(".000Z")), "ai_selected": F.lit(True)})
    return daily.daily_report(rows, "2024-01-10", list(LABELS)).select("day", "n", "lead.title", "lead.paragraph")


@query("api_latest", f"WITH {NOTED} SELECT day AS date, count(*) AS count, md5(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id)) AS items FROM noted WHERE day = (SELECT max(day) FROM noted) GROUP BY day")
def api_latest(spark, d):
    got = exports.latest_of(exports.latest_days(noted(spark, d), 30))
    return got.select("date", "count", F.md5(F.array_join(F.transform("items", lambda x: x.cast("string")), " ")).alias("items"))


@query("api_digest", f"WITH {NOTED}, p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY heat DESC, id) AS place FROM noted) SELECT day AS date, string_agg(CAST(place AS VARCHAR) || ':' || title || ':' || source, ' ' ORDER BY place) AS picks FROM p WHERE place <= 5 AND day = (SELECT max(day) FROM noted) GROUP BY day")
def api_digest(spark, d):
    rows = noted(spark, d)
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("heat"), "id"))
    picks = rows.withColumn("date", F.substring("published_at", 1, 10)).withColumn("place", place).where("place <= 5").select("date", "place", "id", F.lit("hot").alias("reason"))
    return exports.digest_of(rows, picks).select("date", F.array_join(F.transform("picks", lambda x: F.concat_ws(":", x["place"].cast("string"), x["title"], x["source"])), " ").alias("picks"))
