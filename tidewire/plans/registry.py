"""The queries of the library by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.functions import times
from tidewire.operators import boards, classify, dedupe, feed, heat, repos, search, state, stories, taxonomy, trends
from tidewire.sources import archive, exports, tables

NOW = "2024-01-31T00:00:00"
STORY_NOW = "2024-01-04T00:00:00"
CATEGORIES = ["click", "error", "purchase", "signup", "view"]
TIERS = {"en": 1, "de": 2, "fr": 2}
#: Topics of the corpus: patterns over its own words.
TOPICS = {"connectives": "\\b(and|und|et|y)\\b", "articles": "\\b(the|der|die|das|le|la|el)\\b", "endings": "tion\\b|ment\\b|keit\\b", "licence": "licen[sc]e", "insults": "idiot|moron|stupid", "numbers": "[0-9]+"}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ITEMS = """items AS (SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, d.text AS summary, d.source AS source, e.event_type AS category,
strftime(e.ts, '%Y-%m-%dT%H:%M:%S') AS published_at, CAST(floor(e.value) AS BIGINT) AS engagement, d.lang AS origin,
CASE WHEN l.quality IS NULL THEN NULL ELSE l.quality = 1 END AS ai_selected, p.url AS source_url,
CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS BIGINT) AS lines
FROM documents d JOIN events e ON d.doc_id = e.event_id LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id)"""
HEATED = f"""{ITEMS}, each AS (SELECT coalesce(origin, source) g, engagement e, count(*) k FROM items WHERE engagement > 0 GROUP BY 1, 2),
ranks AS (SELECT g, e, CASE WHEN sum(k) OVER (PARTITION BY g) = 1 THEN 1.0 ELSE (2 * sum(k) OVER (PARTITION BY g ORDER BY e) - k) / 2.0 / sum(k) OVER (PARTITION BY g) END p FROM each),
heated AS (SELECT i.*, CASE origin WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 3 END tier, CAST(greatest(1, least(100, floor(
(CASE origin WHEN 'en' THEN 55.0 WHEN 'de' THEN 40.0 WHEN 'fr' THEN 40.0 ELSE 25.0 END + coalesce((p - 0.5) * 30.0, 0.0)) *
(0.55 + 0.45 * exp(-least(greatest((epoch(TIMESTAMP '2024-01-31') - epoch(CAST(published_at AS TIMESTAMP))) / 86400.0, 0.0), 60.0) * ln(2.0) / 7.0)) + 0.5))) AS BIGINT) heat
FROM items i LEFT JOIN ranks r ON coalesce(i.origin, i.source) = r.g AND i.engagement = r.e)"""
STREAM = "stream AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS source, event_type AS category, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS published_at, CAST(floor(value) AS BIGINT) AS heat, strftime(ts, '%Y-%m-%d') AS day FROM events)"
STARS = "stars AS (SELECT l_partkey AS repo, CAST(l_shipdate AS DATE) AS day FROM lineitem), now AS (SELECT max(day) AS today FROM stars)"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def heated(spark: SparkSession, d: str) -> DataFrame:
    return heat.with_heat(tables.items(spark, d), TIERS, NOW)


def stream(spark: SparkSession, d: str) -> DataFrame:
    return tables.stream_items(spark, d).withColumn("day", F.substring("published_at", 1, 10))


def by_heat() -> list:
    return [F.desc("heat"), F.col("id")]


# -- feeds


@query("feed_latest", f"WITH {ITEMS} SELECT id, published_at, source FROM items WHERE ai_selected IS NOT FALSE ORDER BY published_at DESC, id LIMIT 50")
def feed_latest(spark, d):
    return feed.filtered(tables.items(spark, d), feed.FeedQuery()).orderBy(*feed.latest_first()).select("id", "published_at", "source").limit(50)


@query("feed_hot", f"WITH {HEATED} SELECT id, heat, category FROM heated WHERE ai_selected IS NOT FALSE ORDER BY heat DESC, id LIMIT 50")
def feed_hot(spark, d):
    return feed.filtered(heated(spark, d), feed.FeedQuery()).orderBy(*feed.hottest_first()).select("id", "heat", "category").limit(50)


@query("feed_keyword", f"WITH {ITEMS} SELECT id, category FROM items WHERE category = 'view' AND (contains(lower(title), 'idiot') OR contains(lower(summary), 'idiot') OR contains(lower(source), 'idiot'))")
def feed_keyword(spark, d):
    return feed.filtered(tables.items(spark, d), feed.FeedQuery(mode="all", category="view", keyword=" Idiot ")).select("id", "category")


@query("feed_since", f"WITH {ITEMS} SELECT id, published_at FROM items WHERE CAST(published_at AS TIMESTAMP) >= TIMESTAMP '2024-01-31' - INTERVAL 29 DAY")
def feed_since(spark, d):
    return feed.filtered(tables.items(spark, d), feed.FeedQuery(mode="all", since="29d", now=NOW)).select("id", "published_at")


@query("feed_sources", f"WITH {ITEMS} SELECT id, source FROM items WHERE ai_selected IS NOT FALSE AND source IN ('src1', 'src2', 'src3')")
def feed_sources(spark, d):
    return feed.filtered(tables.items(spark, d), feed.FeedQuery(sources=["src1", " src2", "src3", ""])).select("id", "source")


@query("feed_personalized", f"WITH {ITEMS} SELECT id, source IN ('src3') OR category IN ('click') AS followed FROM items WHERE source NOT IN ('src0')")
def feed_personalized(spark, d):
    return feed.personalised(tables.items(spark, d), ["src0"], ["src3"], ["click"]).select("id", "followed")


@query("feed_unread", f"WITH {ITEMS} SELECT i.id FROM items i WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = i.id AND l.toxic = 0)")
def feed_unread(spark, d):
    read = tables.table(spark, d, "labels").where("toxic = 0").select(F.col("doc_id").alias("id"))
    return tables.items(spark, d).join(read, "id", "left_anti").select("id")


@query("feed_bookmarks", f"WITH {ITEMS} SELECT id, '- [' || title || '](' || coalesce(source_url, '') || ')' AS line FROM items WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def feed_bookmarks(spark, d):
    marked = tables.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return tables.items(spark, d).join(marked, "id", "left_semi").select("id", F.concat(F.lit("- ["), "title", F.lit("]("), F.coalesce("source_url", F.lit("")), F.lit(")")).alias("line"))


@query("pagination", f"WITH {STREAM}, t AS (SELECT count(*) AS total FROM stream), r AS (SELECT id, heat, row_number() OVER (ORDER BY heat DESC, id) AS rank FROM stream) SELECT id, heat, rank, CAST(3 AS BIGINT) AS page, total, CAST(ceil(total / 20.0) AS BIGINT) AS total_pages FROM r, t WHERE rank > 40 AND rank <= 60")
def pagination(spark, d):
    return feed.page(stream(spark, d).select("id", "heat"), by_heat(), 3, 20)


# -- scores, cleaning, dedupe


@query("heat_score", f"WITH {HEATED} SELECT id, CAST(tier AS INTEGER) AS tier, heat FROM heated")
def heat_score(spark, d):
    return heated(spark, d).select("id", "tier", "heat")


URL_KEY = "lower(regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '[?#].*$', ''), '/+$', ''))"


@query("dedupe_url", f"WITH k AS (SELECT page_id AS id, {URL_KEY} AS key, row_number() OVER (PARTITION BY {URL_KEY} ORDER BY CASE WHEN length(html) > 0 THEN 2.0 ELSE 0.0 END DESC, page_id) AS n, min(page_id) OVER (PARTITION BY {URL_KEY}) AS place FROM pages) SELECT id, key, place FROM k WHERE n = 1")
def dedupe_url(spark, d):
    rows = tables.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("source_url"), F.col("html").alias("summary"), F.lit(None).cast("boolean").alias("ai_selected"), F.lit(None).cast("long").alias("engagement"))
    return dedupe.by_url(rows).select("id", T.url_key(F.col("source_url")).alias("key"), "place")


TITLE_KEY = "regexp_replace(lower(title), '[\\s\\x{00A0}\\x{3000}\\x{FEFF}\\p{P}\\p{S}]', '', 'g')"


@query("dedupe_title", f"WITH {ITEMS}, k AS (SELECT *, CASE WHEN length({TITLE_KEY}) >= 8 THEN 't:' || {TITLE_KEY} ELSE 'i:' || CAST(id AS VARCHAR) END AS key FROM items), r AS (SELECT id, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN length(summary) > 0 THEN 2.0 ELSE 0.0 END + CASE WHEN ai_selected THEN 0.5 ELSE 0.0 END + coalesce(engagement, 0) * 1e-6 DESC, id) AS n, min(id) OVER (PARTITION BY key) AS place FROM k) SELECT id, place FROM r WHERE n = 1")
def dedupe_title(spark, d):
    return dedupe.by_title(tables.items(spark, d)).select("id", "place")


@query("sanitize_items", f"WITH {ITEMS} SELECT id, substr(trim(source_url), 1, 2048) AS source_url, CASE WHEN engagement > 0 THEN engagement END AS engagement FROM items WHERE trim(title) <> '' AND regexp_matches(trim(source_url), '^https?://') AND length(trim(source_url)) <= 2048")
def sanitize_items(spark, d):
    return classify.sanitised(tables.items(spark, d)).select("id", "source_url", "engagement")


def lit(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit('(?i)' + pattern)})"


REFERENCE = "&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z0-9]+);"
DECODED = f"""CASE WHEN regexp_matches(r, '^&#[xX][0-9a-fA-F]+;$') THEN chr(CAST('0x' || regexp_extract(r, '([0-9a-fA-F]+);$', 1) AS INTEGER)) WHEN regexp_matches(r, '^&#[0-9]+;$') THEN chr(CAST(regexp_extract(r, '([0-9]+);$', 1) AS INTEGER))
ELSE CASE lower(regexp_extract(r, '^&(.*);$', 1)) {' '.join(f"WHEN {lit(n)} THEN {lit(c)}" for n, c in T.REFERENCES.items())} ELSE r END END"""
CLEAN = f"""plain AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
parts AS (SELECT page_id, generate_subscripts(string_split_regex(t, '{REFERENCE}'), 1) AS i, unnest(string_split_regex(t, '{REFERENCE}')) AS p, unnest(list_concat(regexp_extract_all(t, '{REFERENCE}'), [''])) AS r FROM plain),
whole AS (SELECT page_id, string_agg(p || CASE WHEN r = '' THEN '' ELSE {DECODED} END, '' ORDER BY i) AS t FROM parts GROUP BY page_id)"""


@query("clean_html", f"WITH {CLEAN} SELECT page_id, trim(regexp_replace(t, '{T.BLANK}+', ' ', 'g')) AS text FROM whole")
def clean_html(spark, d):
    return tables.table(spark, d, "pages").select("page_id", T.clean_html(F.col("html")).alias("text"))


# -- classes and topics

TOPIC_SQL = ", ".join(f"CASE WHEN regexp_matches(lower(summary), '{p}') THEN '{n}' END" for n, p in TOPICS.items())
TAGGED = f"{ITEMS}, tagged AS (SELECT id, published_at, unnest(list_filter([{TOPIC_SQL}], lambda x: x IS NOT NULL)) AS tag FROM items)"


def tagged(spark, d):
    return tables.tagged_documents(spark, d, lambda text: classify.tags(F.lower(text), TOPICS))


@query("classify_items", f"WITH {ITEMS} SELECT id, CASE WHEN contains(source, 'src1') THEN 'wire' WHEN regexp_matches(lower(summary), 'licen[sc]e') THEN 'legal' WHEN regexp_matches(lower(summary), 'token *=') THEN 'code' WHEN contains(lower(summary), '|') THEN 'table' ELSE 'prose' END AS class FROM items")
def classify_items(spark, d):
    low = F.lower("summary")
    rules = [("wire", F.contains("source", F.lit("src1"))), ("legal", low.rlike("licen[sc]e")), ("code", low.rlike("token *=")), ("table", F.contains(low, F.lit("|")))]
    return tables.items(spark, d).select("id", classify.first_match(rules, "prose").alias("class"))


@query("entity_tags", f"WITH {TAGGED} SELECT id, tag FROM tagged")
def entity_tags(spark, d):
    return tagged(spark, d).select("id", F.explode("tags").alias("tag"))


@query("entity_counts", f"WITH {TAGGED} SELECT tag, count(*) AS n FROM tagged GROUP BY tag")
def entity_counts(spark, d):
    return classify.tag_counts(tagged(spark, d))


@query("hot_topics", f"WITH {TAGGED} SELECT tag, count(*) AS n FROM tagged GROUP BY tag HAVING count(*) >= 5 ORDER BY n DESC, tag LIMIT 12")
def hot_topics(spark, d):
    return classify.tag_counts(tagged(spark, d)).where("n >= 5").orderBy(F.desc("n"), "tag").limit(12)


STRONG, WEAK, WHOLE = ["idiot", "licensed under", "moron"], ["apache", "token", "mail", "onan", "rees"], {"token", "moron"}


@query("ai_filter", f"WITH {ITEMS} SELECT id FROM items WHERE contains(lower(summary), 'idiot') OR contains(lower(summary), 'licensed under') OR regexp_matches(lower(summary), '\\bmoron\\b') OR (CAST(contains(lower(summary), 'apache') AS INT) + CAST(regexp_matches(lower(summary), '\\btoken\\b') AS INT) + CAST(contains(lower(summary), 'mail') AS INT) + CAST(contains(lower(summary), 'onan') AS INT) + CAST(contains(lower(summary), 'rees') AS INT)) >= 2")
def ai_filter(spark, d):
    return tables.items(spark, d).where(classify.relevant(F.col("summary"), STRONG, WEAK, WHOLE)).select("id")


# -- days, weeks, trends


@query("daily_counts", f"WITH {STREAM} SELECT day, count(*) AS total, " + ", ".join(f"count(*) FILTER (category = '{c}') AS n_{c}" for c in CATEGORIES) + " FROM stream GROUP BY day")
def daily_counts(spark, d):
    return trends.daily_counts(stream(spark, d), CATEGORIES, F.col("day"))


TREND = f"{TAGGED}, e AS (SELECT tag AS topic, substr(published_at, 1, 10) AS day, count(*) AS n FROM tagged GROUP BY 1, 2), t AS (SELECT topic, CAST(sum(n) AS BIGINT) AS total FROM e GROUP BY 1 ORDER BY total DESC, topic LIMIT 3)"


def trended(spark, d):
    return trends.topic_trends(tagged(spark, d).select("published_at", F.explode("tags").alias("tag")), "tag", F.substring("published_at", 1, 10), 3)


@query("topic_trends", f"WITH {TREND} SELECT e.topic, e.day, e.n, t.total FROM e JOIN t USING (topic)")
def topic_trends(spark, d):
    return trended(spark, d).select("topic", "day", "n", "total")


@query("trend_densified", f"WITH {TREND}, s AS (SELECT e.topic, e.day, e.n FROM e JOIN t USING (topic)), days AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events) SELECT x.topic, days.day, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT topic FROM s) x, days LEFT JOIN s ON s.topic = x.topic AND s.day = days.day")
def trend_densified(spark, d):
    return trends.densified(trended(spark, d).select("topic", "day", "n"), stream(spark, d))


@query("trend_summary", f"WITH {STREAM}, c AS (SELECT day, count(*) AS n FROM stream GROUP BY day) SELECT CAST(sum(n) AS BIGINT) AS total, CAST(floor(sum(n) / count(*) + 0.5) AS BIGINT) AS average, (SELECT day FROM c ORDER BY n DESC, day LIMIT 1) AS best_day, max(n) AS best FROM c")
def trend_summary(spark, d):
    c = stream(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.sum("n").alias("total"), F.floor(F.sum("n") / F.count(F.lit(1)) + 0.5).alias("average"), F.min_by("day", F.struct(-F.col("n"), "day")).alias("best_day"), F.max("n").alias("best"))


@query("timeline_top5", f"WITH {STREAM}, d AS (SELECT DISTINCT day FROM stream ORDER BY day DESC LIMIT 30), r AS (SELECT s.day, id, heat, row_number() OVER (PARTITION BY s.day ORDER BY heat DESC, id) AS rank FROM stream s JOIN d ON s.day = d.day) SELECT * FROM r WHERE rank <= 5")
def timeline_top5(spark, d):
    rows = trends.latest_days(stream(spark, d).drop("day"), F.substring("published_at", 1, 10), 30)
    return trends.top_per(rows, ["day"], by_heat(), 5).select("day", "id", "heat", "rank")


WEEK = "day BETWEEN '2024-01-15' AND '2024-01-21'"


def week_items(spark, d):
    return stream(spark, d).where(F.col("day").between("2024-01-15", "2024-01-21"))


@query("weekly_top10_capped", f"WITH {STREAM}, r AS (SELECT id, source, heat, row_number() OVER (PARTITION BY source ORDER BY heat DESC, id) AS n FROM stream WHERE {WEEK}) SELECT id, source, heat, row_number() OVER (ORDER BY heat DESC, id) AS rank FROM r WHERE n <= 4 ORDER BY heat DESC, id LIMIT 10")
def weekly_top10_capped(spark, d):
    return trends.capped_top(week_items(spark, d).select("id", "source", "heat"), 4, 10, by_heat())


@query("weekly_sections", f"WITH {STREAM}, r AS (SELECT category, id, heat, row_number() OVER (PARTITION BY category ORDER BY heat DESC, id) AS rank FROM stream WHERE {WEEK}) SELECT * FROM r WHERE rank <= 5")
def weekly_sections(spark, d):
    return trends.top_per(week_items(spark, d), ["category"], by_heat(), 5).select("category", "id", "heat", "rank")


@query("weekly_breakdown", f"WITH {STREAM}, axis AS (SELECT strftime(DATE '2024-01-15' + CAST(i AS INTEGER), '%Y-%m-%d') AS day FROM range(7) t(i)) SELECT axis.day, count(s.id) AS n FROM axis LEFT JOIN stream s ON s.day = axis.day GROUP BY axis.day")
def weekly_breakdown(spark, d):
    axis = spark.range(7).select(F.date_format(F.date_add(F.lit("2024-01-15"), F.col("id").cast("int")), "yyyy-MM-dd").alias("day"))
    return axis.join(week_items(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n")), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("weekly_wow", f"WITH {STREAM}, w AS (SELECT strftime(date_trunc('week', CAST(day AS DATE)), '%Y-%m-%d') AS week, count(*) AS total FROM stream GROUP BY 1) SELECT week, total, lag(total) OVER (ORDER BY week) AS previous, total - lag(total) OVER (ORDER BY week) AS change FROM w")
def weekly_wow(spark, d):
    return trends.week_over_week(stream(spark, d), F.col("day"))


@query("daily_sections", f"WITH {STREAM}, r AS (SELECT category, id, heat, row_number() OVER (PARTITION BY category ORDER BY heat DESC, published_at DESC, id) AS rank FROM stream WHERE day = '2024-01-10') SELECT * FROM r WHERE rank <= 6")
def daily_sections(spark, d):
    order = [F.desc("heat"), F.desc("published_at"), F.col("id")]
    return trends.top_per(stream(spark, d).where("day = '2024-01-10'"), ["category"], order, 6).select("category", "id", "heat", "rank")


@query("daily_flashes", f"WITH {STREAM} SELECT id, published_at FROM stream WHERE day = '2024-01-10' ORDER BY published_at DESC, id LIMIT 6")
def daily_flashes(spark, d):
    return stream(spark, d).where("day = '2024-01-10'").orderBy(F.desc("published_at"), "id").select("id", "published_at").limit(6)


@query("daily_featured", f"WITH {HEATED} SELECT id, heat FROM heated WHERE substr(published_at, 1, 10) = '2024-01-01' AND ai_selected IS NOT FALSE ORDER BY heat DESC, published_at DESC, id LIMIT 6")
def daily_featured(spark, d):
    rows = feed.filtered(heated(spark, d).where(F.substring("published_at", 1, 10) == "2024-01-01"), feed.FeedQuery())
    return rows.orderBy(*feed.hottest_first(F.desc("published_at"))).select("id", "heat").limit(6)


@query("daily_dates", f"WITH {STREAM} SELECT day, count(*) AS n FROM stream GROUP BY day HAVING count(*) >= 3 ORDER BY day DESC LIMIT 30")
def daily_dates(spark, d):
    return stream(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").orderBy(F.desc("day")).limit(30)


@query("source_counts", f"WITH {STREAM} SELECT source, count(*) AS n FROM stream GROUP BY source")
def source_counts(spark, d):
    return stream(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("site_stats", f"WITH {STREAM} SELECT count(*) AS total, count(DISTINCT day) AS days, CAST(floor(count(*) / count(DISTINCT day) + 0.5) AS BIGINT) AS per_day, count(DISTINCT source) AS sources FROM stream")
def site_stats(spark, d):
    days = F.count_distinct("day")
    return stream(spark, d).agg(F.count(F.lit(1)).alias("total"), days.alias("days"), F.floor(F.count(F.lit(1)) / days + 0.5).alias("per_day"), F.count_distinct("source").alias("sources"))


# -- repositories


def gained(spark, d):
    rows = tables.stars(spark, d)
    today = rows.agg(F.max("day").alias("today"))
    return trends.gains(rows.join(F.broadcast(today)), F.col("today"))  # one row


GAINS = f"{STARS}, gains AS (SELECT repo, count(*) FILTER (day > today - 1) AS gain_1, count(*) FILTER (day > today - 7) AS gain_7, count(*) FILTER (day > today - 30) AS gain_30, count(*) AS stars FROM stars, now GROUP BY repo)"


@query("star_gains", f"WITH {GAINS} SELECT * FROM gains")
def star_gains(spark, d):
    return gained(spark, d)


@query("repo_momentum", f"WITH {GAINS} SELECT repo, gain_7 + 3 * gain_1 + gain_30 / 4.0 AS hot, CASE WHEN gain_7 / 7.0 < 20 THEN NULL WHEN gain_1 / 1.0 > 1.5 * (gain_7 / 7.0) THEN 'up' WHEN gain_1 / 1.0 < 0.6 * (gain_7 / 7.0) THEN 'down' END AS direction FROM gains")
def repo_momentum(spark, d):
    return trends.momentum(gained(spark, d)).select("repo", F.col("hot").cast("double"), "direction")


@query("breakouts", f"WITH {GAINS} SELECT repo, gain_1, gain_7 FROM gains WHERE gain_7 = 0 OR gain_1 / (gain_7 / 7.0) >= 1.8")
def breakouts(spark, d):
    rows = gained(spark, d).withColumns({"daily": F.col("gain_1"), "weekly": F.col("gain_7"), "sources": F.array(F.lit("trending"))})
    return boards.breakouts(rows).select("repo", "gain_1", "gain_7")


def parts(spark, d):
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("topics"), F.col("p_type").alias("track"), F.col("p_size").cast("long").alias("heat"))


PARTS = "parts AS (SELECT p_partkey AS id, p_name AS name, p_brand AS topics, p_type AS track, CAST(p_size AS BIGINT) AS heat FROM part)"


@query("first_of_kind", f"WITH {PARTS}, r AS (SELECT id, track, heat, CAST(row_number() OVER (PARTITION BY track ORDER BY heat DESC, id) > 1 AS INT) AS later FROM parts) SELECT id, track, heat, row_number() OVER (ORDER BY later, heat DESC, id) AS place FROM r ORDER BY later, heat DESC, id LIMIT 6")
def first_of_kind(spark, d):
    return trends.first_of_kind(parts(spark, d).select("id", "track", "heat"), "track", by_heat())


@query("track_share", f"WITH {PARTS} SELECT track, count(*) AS n, CAST(floor(100.0 * count(*) / sum(count(*)) OVER () + 0.5) AS BIGINT) AS share FROM parts GROUP BY track")
def track_share(spark, d):
    each = parts(spark, d).groupBy("track").agg(F.count(F.lit(1)).alias("n"))
    return each.select("track", "n", F.floor(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()) + 0.5).alias("share"))


@query("streaks", f"WITH {STREAM}, r AS (SELECT DISTINCT source, CAST(day AS DATE) AS day FROM stream), i AS (SELECT source, day, day - CAST(row_number() OVER (PARTITION BY source ORDER BY day) AS INTEGER) AS island FROM r), g AS (SELECT source, island, count(*) AS n, max(day) AS last FROM i GROUP BY 1, 2) SELECT source, arg_max(n, last) AS streak FROM g GROUP BY source")
def streaks(spark, d):
    return trends.streaks(stream(spark, d).select("source", F.to_date("day").alias("day")), "source")


@query("history_nearest", f"WITH {STARS}, h AS (SELECT repo, day, count(*) AS value FROM stars GROUP BY 1, 2), m AS (SELECT repo, day, value, row_number() OVER (PARTITION BY repo ORDER BY day) AS n FROM h, now WHERE abs(day - (today - 30)) <= 1) SELECT repo, strftime(day, '%Y-%m-%d') AS day, value FROM m WHERE n = 1")
def history_nearest(spark, d):
    rows = tables.stars(spark, d)
    today = rows.agg(F.max("day").alias("today"))
    history = rows.groupBy("repo", "day").agg(F.count(F.lit(1)).alias("value")).join(F.broadcast(today))
    return trends.nearest_sample(history, "repo", F.col("today"), 30).select("repo", F.date_format("day", "yyyy-MM-dd").alias("day"), "value")


@query("cascading_exclusion", f"WITH {PARTS}, top AS (SELECT id FROM parts ORDER BY heat DESC, id LIMIT 3), fun AS (SELECT id FROM parts WHERE topics = 'Brand#2' AND id NOT IN (SELECT id FROM top) ORDER BY heat DESC, id LIMIT 3) SELECT id, 'top' AS shelf FROM top UNION ALL SELECT id, 'fun' FROM fun UNION ALL SELECT * FROM (SELECT id, 'rest' FROM parts WHERE id NOT IN (SELECT id FROM top) AND id NOT IN (SELECT id FROM fun) ORDER BY heat DESC, id LIMIT 5)")
def cascading_exclusion(spark, d):
    rows = parts(spark, d)
    top = rows.orderBy(*by_heat()).limit(3).select("id")
    fun = rows.where("topics = 'Brand#2'").join(top, "id", "left_anti").orderBy(*by_heat()).limit(3).select("id")
    rest = rows.join(top, "id", "left_anti").join(fun, "id", "left_anti").orderBy(*by_heat()).limit(5).select("id")
    return top.withColumn("shelf", F.lit("top")).unionByName(fun.withColumn("shelf", F.lit("fun"))).unionByName(rest.withColumn("shelf", F.lit("rest")))


# -- state


def halves(spark, d):
    rows = stream(spark, d).select("id", "source", "heat", "published_at")
    return rows.where("published_at < '2024-01-20'"), rows.where("published_at >= '2024-01-11'").withColumn("heat", F.col("heat") + 1)


HALVES = f"{STREAM}, a AS (SELECT id, source, heat, published_at FROM stream WHERE published_at < '2024-01-20'), b AS (SELECT id, source, heat + 1 AS heat, published_at FROM stream WHERE published_at >= '2024-01-11')"


@query("archive_upsert", f"WITH {HALVES} SELECT id, heat, substr(published_at, 1, 7) AS month FROM b UNION ALL SELECT id, heat, substr(published_at, 1, 7) FROM a WHERE id NOT IN (SELECT id FROM b)")
def archive_upsert(spark, d):
    old, new = halves(spark, d)
    return archive.with_month(archive.upserted(old, new).withColumn("first_seen", F.lit(""))).select("id", "heat", "month")


@query("history_join", f"WITH {HALVES} SELECT b.id, coalesce(a.published_at, 'now') AS first_seen FROM b LEFT JOIN a ON a.id = b.id")
def history_join(spark, d):
    old, new = halves(spark, d)
    return state.with_history(new, old.withColumn("first_seen", F.col("published_at")), "now").select("id", "first_seen")


@query("pool_merge", f"WITH {HALVES} SELECT id, heat FROM b UNION ALL SELECT id, heat FROM a WHERE id NOT IN (SELECT id FROM b)")
def pool_merge(spark, d):
    old, new = halves(spark, d)
    return state.pool(new, old).select("id", "heat")


@query("carry_over", f"WITH {HALVES} SELECT id, heat FROM b UNION ALL SELECT id, heat FROM a WHERE source IN ('1', '2', '3') AND id NOT IN (SELECT id FROM b)")
def carry_over(spark, d):
    old, new = halves(spark, d)
    return state.carried_over(new, old, ["1", "2", "3"]).select("id", "heat")


@query("sanitize_conversations", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) <= 8 AND bool_and(coalesce(role IN ('system', 'user', 'assistant') AND text IS NOT NULL, FALSE))")
def sanitize_conversations(spark, d):
    return state.sanitised_conversations(tables.table(spark, d, "conversations"))


# -- stories and search

WORDS = f"list_distinct(list_filter(list_transform(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9.-]*'), lambda x: regexp_replace(x, '^[.-]+|[.-]+$', '', 'g')), lambda x: length(x) >= 2 AND x NOT IN ({', '.join(repr(s) for s in T.STOP_WORDS)})))"
HAY = "(title || ' ' || coalesce(summary, '') || ' ')"
TOPIC_LIST = "list_filter([" + ", ".join(f"CASE WHEN {has(HAY, p)} THEN {lit(n)} END" for n, p in taxonomy.TOPICS.items()) + "], lambda x: x IS NOT NULL)"


@query("title_tokens", f"WITH {ITEMS} SELECT id, unnest({WORDS}) AS token FROM items")
def title_tokens(spark, d):
    return tables.items(spark, d).select("id", F.explode(T.story_tokens(F.col("title"))).alias("token"))


PAIRS = f"""{HEATED}, pool AS (SELECT id, source, published_at, title, heat, epoch(CAST(published_at AS TIMESTAMP)) AS moment, {WORDS} AS tokens, {TOPIC_LIST} AS topics FROM heated
WHERE CAST(published_at AS TIMESTAMP) BETWEEN TIMESTAMP '{STORY_NOW}' - INTERVAL 14 DAY AND TIMESTAMP '{STORY_NOW}' + INTERVAL 1 DAY), w AS (SELECT id, unnest(tokens) AS token FROM pool),
c AS (SELECT token FROM w GROUP BY token HAVING count(*) BETWEEN 2 AND 50), s AS (SELECT w.id, w.token FROM w JOIN c USING (token)),
m AS (SELECT DISTINCT x.id AS a, y.id AS b FROM s x JOIN s y ON x.token = y.token AND x.id < y.id),
h AS (SELECT a, b, len(list_intersect(p.tokens, q.tokens)) AS shared, len(p.tokens) + len(q.tokens) AS sizes FROM m JOIN pool p ON p.id = a JOIN pool q ON q.id = b WHERE abs(p.moment - q.moment) <= 259200 AND (len(p.topics) = 0 OR len(q.topics) = 0 OR list_has_any(p.topics, q.topics))),
pairs AS (SELECT a, b, shared, shared / (sizes - shared) AS likeness FROM h WHERE shared >= 2 AND shared / (sizes - shared) >= 0.3)"""


@query("story_pairs", f"WITH {PAIRS} SELECT a, b, shared, round(likeness, 6) AS likeness FROM pairs")
def story_pairs(spark, d):
    return stories.pairs(tables.items(spark, d), STORY_NOW).withColumn("likeness", F.round("likeness", 6))


STORIES = f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), r AS (SELECT x AS id, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id), l AS (SELECT id, min(root) AS root FROM r GROUP BY id),
g AS (SELECT l.root, p.*, row_number() OVER (PARTITION BY root ORDER BY moment, id) AS f, row_number() OVER (PARTITION BY root ORDER BY moment DESC, id DESC) AS z, row_number() OVER (PARTITION BY root ORDER BY heat DESC, moment DESC, id) AS t FROM l JOIN pool p USING (id)),
told AS (SELECT max(id) FILTER (f = 1) AS story, max(title) FILTER (t = 1) AS title, count(*) AS n_items, count(DISTINCT source) AS n_sources, max(published_at) FILTER (f = 1) AS first_time, max(published_at) FILTER (z = 1) AS last_time, max(heat) AS heat,
CASE WHEN epoch(TIMESTAMP '{STORY_NOW}') - max(moment) > 129600 THEN 'settled' WHEN count(DISTINCT substr(published_at, 1, 10)) >= 2 THEN 'developing' ELSE 'new' END AS status FROM g GROUP BY root HAVING count(*) >= 2 AND count(DISTINCT source) >= 2)"""


#: The same, but however common a token is, it brings items together.
ALL_STORIES = STORIES.replace("HAVING count(*) BETWEEN 2 AND 50", "HAVING count(*) >= 2")


def told(spark, d, every: bool = False):
    return stories.stories(heated(spark, d), STORY_NOW, every)


@query("stories", f"{STORIES} SELECT * FROM told")
def story_rollup(spark, d):
    return told(spark, d).select("story", "title", "n_items", "n_sources", "first_time", "last_time", "heat", "status")


@query("rag_retrieve", f"WITH {HEATED}, s AS (SELECT id, round((CASE WHEN contains(lower(title), 'the idiot') THEN 10 ELSE 0 END) + (CASE WHEN contains(lower(title), 'the') THEN 5 ELSE 0 END) + (CASE WHEN contains(lower(summary), 'the') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(source), 'the') THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(title), 'idiot') THEN 5 ELSE 0 END) + (CASE WHEN contains(lower(summary), 'idiot') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(source), 'idiot') THEN 3 ELSE 0 END) + least(heat / 40.0, 3.0), 6) AS score FROM heated) SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 15")
def rag_retrieve(spark, d):
    return search.retrieved(heated(spark, d), "The idiot").select("id", "score")


@query("concept_search", f"WITH {PARTS}, h AS (SELECT id, greatest(CASE WHEN regexp_matches(lower(name), '(^|[^a-z0-9])(ring|bolt)') THEN 5 ELSE 0 END, CASE WHEN regexp_matches(lower(topics), '(^|[^a-z0-9])(ring|bolt)') THEN 3 ELSE 0 END) AS h0, greatest(CASE WHEN regexp_matches(lower(name), '(^|[^a-z0-9])(red|small)') THEN 5 ELSE 0 END, CASE WHEN regexp_matches(lower(topics), '(^|[^a-z0-9])(red|small)') THEN 3 ELSE 0 END) AS h1 FROM parts), c AS (SELECT count(*) AS n, count(*) FILTER (h0 > 0) AS d0, count(*) FILTER (h1 > 0) AS d1 FROM h), s AS (SELECT id, round(ln(1 + n / (1 + d0)) * h0 + ln(1 + n / (1 + d1)) * h1, 6) AS score FROM h, c WHERE d0 > 0 AND d1 > 0) SELECT id, score FROM s WHERE score > 0 AND score >= 0.5 * (SELECT max(score) FROM s)")
def concept_search(spark, d):
    return search.concept_ranked(parts(spark, d), [["ring", "bolt"], ["red", "small"]], {"name": 5, "topics": 3})


@query("wide_rerank", f"WITH {PARTS}, h AS (SELECT id, CASE WHEN regexp_matches(lower(name), '(^|[^a-z0-9])widget') THEN 5 ELSE 0 END AS h0, CASE WHEN regexp_matches(lower(name), '(^|[^a-z0-9])red') THEN 5 ELSE 0 END AS h1 FROM parts) SELECT id, CAST(h0 + h1 AS BIGINT) AS score FROM h WHERE h0 > 0 AND h1 > 0")
def wide_rerank(spark, d):
    return search.reranked(parts(spark, d), [["widget"], ["red"]], {"name": 5})


# -- exports, times and repositories


@query("editorial_days", "WITH s AS (SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, strftime(date_trunc('week', ts + INTERVAL 8 HOUR), '%Y-%m-%d') AS week FROM (SELECT date_trunc('second', ts) AS ts FROM events)) SELECT day, week, count(*) AS n FROM s GROUP BY day, week")
def editorial_days(spark, d):
    at = F.col("published_at")
    return stream(spark, d).groupBy(times.editorial_day(at).alias("day"), times.editorial_week(at).alias("week")).agg(F.count(F.lit(1)).alias("n"))


XML = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("feed_export", f"WITH {ITEMS}, t AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, id) AS place FROM items) SELECT place, '<item><title>' || {XML.format('title')} || '</title><link>' || {XML.format(chr(99) + 'oalesce(source_url, ' + chr(39) * 2 + ')')} || '</link><guid>' || CAST(id AS VARCHAR) || '</guid><description>' || {XML.format('CASE WHEN summary <> ' + chr(39) * 2 + ' THEN summary ELSE title END')} || '</description></item>' AS entry FROM t WHERE place <= 30")
def feed_export(spark, d):
    return exports.rss_entries(tables.items(spark, d))


@query("sitemap", f"WITH {TAGGED}, n AS (SELECT tag, count(*) AS n FROM tagged GROUP BY tag) SELECT 'https://site.example/' AS url UNION ALL SELECT 'https://site.example/about' UNION ALL SELECT 'https://site.example/topic/' || tag FROM n WHERE n >= 5 UNION ALL SELECT DISTINCT 'https://site.example/daily/' || substr(published_at, 1, 10) FROM items")
def sitemap(spark, d):
    days = tables.items(spark, d).select(F.substring("published_at", 1, 10).alias("day")).distinct()
    return exports.sitemap("https://site.example", classify.tag_counts(tagged(spark, d)), days, ["/", "/about"])


REPOS = f"{PARTS}, p AS (SELECT 'http://' || CAST(id AS VARCHAR) AS x, * FROM parts), repos AS (SELECT 'r' || CAST(page_id AS VARCHAR) AS full_name, lower(regexp_replace(regexp_replace(url, '[#?].*$', ''), '/+$', '')) AS url, page_id AS ord, CASE WHEN page_id % 3 = 0 THEN page_id % 7 END AS weekly, CASE WHEN page_id % 2 = 0 THEN page_id % 5 END AS daily, page_id % 11 AS monthly FROM pages)"


@query("trend_attach", f"WITH {ITEMS}, {REPOS}, m AS (SELECT *, CASE WHEN weekly IS NOT NULL THEN 'weekly' WHEN daily IS NOT NULL THEN 'daily' ELSE 'monthly' END AS period, coalesce(weekly, daily, monthly) AS gained, row_number() OVER (PARTITION BY url ORDER BY ord DESC) AS n FROM repos), w AS (SELECT e.event_id AS id, arg_min('r' || CAST(user_id AS VARCHAR), e.event_id) AS full_name FROM events e GROUP BY 1), j AS (SELECT i.id, coalesce(u.full_name, v.full_name) AS repo, CASE WHEN u.full_name IS NOT NULL THEN u.period ELSE v.period END AS period, CASE WHEN u.full_name IS NOT NULL THEN u.gained ELSE v.gained END AS gained FROM items i LEFT JOIN m u ON u.n = 1 AND u.url = lower(regexp_replace(regexp_replace(i.source_url, '[#?].*$', ''), '/+$', '')) LEFT JOIN w ON w.id = i.id LEFT JOIN m v ON v.full_name = w.full_name) SELECT id, CASE WHEN gained > 0 THEN repo END AS repo, CASE WHEN gained > 0 THEN period END AS period, CASE WHEN gained > 0 THEN gained END AS gained FROM j")
def trend_attach(spark, d):
    page = F.col("page_id")
    found = tables.table(spark, d, "pages").select(F.concat(F.lit("r"), page.cast("string")).alias("full_name"), repos.plain_url(F.col("url")).alias("url"), page.alias("ord"), F.when(page % 3 == 0, page % 7).alias("weekly"), F.when(page % 2 == 0, page % 5).alias("daily"), (page % 11).alias("monthly"))
    news = tables.table(spark, d, "events").select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("full_name"), F.col("event_id").alias("ord"), F.col("event_id").alias("id"))
    return repos.with_trend(tables.items(spark, d), found, news).select("id", "repo", "period", "gained")


@query("news_match", f"WITH {ITEMS}, r AS (SELECT 'b' || CAST(item_id AS VARCHAR) AS repo, lower(regexp_extract(text, '[A-Za-z]+', 0)) AS token FROM benchmark), t AS (SELECT id, published_at, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9_.-]*'))) AS token FROM items WHERE CAST(published_at AS TIMESTAMP) >= TIMESTAMP '2024-01-31' - INTERVAL 45 DAY), m AS (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY published_at DESC, id) AS rank FROM t JOIN r USING (token)) SELECT * FROM m WHERE rank <= 5")
def news_match(spark, d):
    names = tables.table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("full_name"), F.regexp_extract("text", "[A-Za-z]+", 0).alias("name"))
    return repos.mentioned(tables.items(spark, d), names, 45, NOW)
