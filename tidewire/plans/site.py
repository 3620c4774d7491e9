"""Queries of the site's catalogues, repository board, reports, notes and stories, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import notes, times
from tidewire.functions import text as T
from tidewire.operators import boards, classify, daily, dedupe, news, repo_kinds, repos, search, state, stories, taxonomy, trends, weekly
from tidewire.operators.repo_kinds import FUN, RULES
from tidewire.plans import registry as R
from tidewire.plans.registry import HAY, HEATED, ITEMS, NOW, TOPIC_LIST, has, lit, query
from tidewire.sources import archive, exports, snapshots, tables


# -- categories and topics of items whose titles begin with a headline

HEADLINES = [
    "OpenAI releases GPT-5", "Anthropic unveils Claude for coding", "How to tune RAG", "A survey of multimodal models", "Chip maker plans an IPO", "DeepSeek open source model", "Robots at home", "Policy on video generation", "通义千问发布新模型",
    "New assistant app launched", "Hugging Face and agents", "Google and Meta", "A quiet day", "GPU funding", "Copilot API announced", "教程：智能体",
]


def sql_list(values: list) -> str:
    return "[" + ", ".join(lit(v) if isinstance(v, str) else f"CAST({sql_list(v)} AS VARCHAR[])" for v in values) + "]"


def pick(values: list, k) -> F.Column:
    each = [F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)).cast("array<string>") for v in values]
    return F.get(F.array(*each), (k % len(values)).cast("int"))


TITLED = f"{ITEMS}, titled AS (SELECT * REPLACE (({sql_list(HEADLINES)})[id % {len(HEADLINES)} + 1] || '. ' || title AS title) FROM items)"


def titled(spark, d):
    return tables.items(spark, d).withColumn("title", F.concat(pick(HEADLINES, F.col("id")), F.lit(". "), "title"))


CASCADE = f"""CASE WHEN origin IN ('hf-papers', 'arxiv') OR {has('source', taxonomy.PAPER_SOURCES)} THEN 'paper'
WHEN {has(HAY, taxonomy.MODEL_FAMILIES)} AND {has(HAY, taxonomy.RELEASE_WORDS)} THEN 'ai-models'
WHEN origin = 'github' OR ({has(HAY, taxonomy.PRODUCT_WORDS)} AND {has(HAY, taxonomy.RELEASE_WORDS)}) THEN 'ai-products'
WHEN {has(HAY, taxonomy.INDUSTRY_WORDS)} THEN 'industry' WHEN origin = 'rss:hf-blog' OR {has(HAY, taxonomy.TIP_WORDS)} THEN 'tip' WHEN {has(HAY, taxonomy.PAPER_WORDS)} THEN 'paper' ELSE coalesce(category, 'industry') END"""


@query("category_cascade", f"WITH {TITLED} SELECT id, {CASCADE} AS category, 0 AS heat FROM titled")
def category_cascade(spark, d):
    return taxonomy.with_category(titled(spark, d)).select("id", "category", "heat")


TOPICS = f"{TITLED}, topical AS (SELECT id, {TOPIC_LIST} AS topics FROM titled)"


@query("topic_tags", f"WITH {TOPICS} SELECT id, unnest(topics) AS slug FROM topical")
def topic_tags(spark, d):
    return taxonomy.with_topics(titled(spark, d)).select("id", F.explode("topics").alias("slug"))


@query("topic_overview", f"WITH {TOPICS}, n AS (SELECT slug, count(*) AS n FROM (SELECT unnest(topics) AS slug FROM topical) GROUP BY slug) SELECT slug, CAST(list_position([{', '.join(map(lit, taxonomy.TOPICS))}], slug) - 1 AS INTEGER) AS place, n FROM n")
def topic_overview(spark, d):
    return taxonomy.topic_overview(taxonomy.with_topics(titled(spark, d)))


@query("topic_members", f"WITH {TOPICS}, e AS (SELECT id, unnest(topics) AS slug FROM topical) SELECT slug, id FROM e WHERE slug IN (SELECT slug FROM e GROUP BY slug HAVING count(*) >= 5)")
def topic_members(spark, d):
    return taxonomy.topic_members(taxonomy.with_topics(titled(spark, d)))


# -- repositories: a view over parts whose texts come from a list of phrases

OWNERS = ["openai", "acme-ai", "nvlabs", "dev", "google-research", "tinylab"]
PHRASES = [
    "An agent SDK with a runtime for tools", "Tutorial on LLMs for beginners", "World models for robots. Fast", "A vector database with embeddings", "Code for the paper on neural fields", "MCP server for browsers",
    "A coding agent for your terminal", "Long-term memory for agents", "Plain CSV parser", "Quantized inference in pure C", "A game with playable NPCs", "Voice cloning and dubbing by AI", "Awesome list of books. For AI", "Benchmark datasets for vision",
    "Text-to-image with stickers", "", "A novel writing companion for fun", "skills and plugins for claude", "Robot arms without learning", "NSFW face swap game", "Course on Go", "Run LLMs on-device", "desktop pet with memory", "Music from text", "self-driving 3d worlds",
]
TAGS = [[], ["llm", "pytorch"], ["world-models"], ["cli", "rust-lang"], ["machine-learning", "tutorial"]]


REPO_VIEW = f"""repos AS (SELECT p_partkey AS k, ({sql_list(OWNERS)})[p_partkey % {len(OWNERS)} + 1] || '/' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR) AS full_name,
CASE WHEN p_partkey % 17 <> 0 THEN ({sql_list(PHRASES)})[p_partkey % {len(PHRASES)} + 1] END AS description, ({sql_list(TAGS)})[p_partkey % {len(TAGS)} + 1] AS topics, p_partkey % 13 = 0 AS has_paper,
p_partkey * 31 % 5000 AS stars, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 7 % 50 END AS daily, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey * 13 % 400 END AS weekly, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 17 % 900 END AS monthly,
CASE WHEN p_partkey % 2 = 0 THEN ['trending'] WHEN p_partkey % 7 = 0 THEN ['paper', 'discover'] ELSE ['discover'] END AS sources, p_type AS track, CASE WHEN p_partkey % 6 = 0 THEN 'game' END AS fun,
p_brand AS language, CASE WHEN p_partkey % 3 = 0 THEN '#' || p_brand END AS language_color, p_size AS age FROM part)"""


def repo_view(spark, d):
    k = F.col("p_partkey")
    part = tables.table(spark, d, "part")
    return part.select(
        k.alias("k"), F.concat(pick(OWNERS, k), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), k.cast("string")).alias("full_name"),
        F.when(k % 17 != 0, pick(PHRASES, k)).alias("description"), pick(TAGS, k).alias("topics"), (k % 13 == 0).alias("has_paper"),
        (k * 31 % 5000).alias("stars"), F.when(k % 3 != 0, k * 7 % 50).alias("daily"), F.when(k % 4 != 0, k * 13 % 400).alias("weekly"), F.when(k % 5 != 0, k * 17 % 900).alias("monthly"),
        F.when(k % 2 == 0, F.array(F.lit("trending"))).when(k % 7 == 0, F.array(F.lit("paper"), F.lit("discover"))).otherwise(F.array(F.lit("discover"))).alias("sources"), F.col("p_type").alias("track"), F.when(k % 6 == 0, "game").alias("fun"),
        F.col("p_brand").alias("language"), F.when(k % 3 == 0, F.concat(F.lit("#"), "p_brand")).alias("language_color"), F.col("p_size").alias("age"),
    )


def first_rule(text: str, rules: list[int]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {lit(RULES[k].pattern)}) THEN {k}" for k in rules) + " END"


def signal(text: str, state: str) -> str:
    return f"CASE {state} " + " ".join(f"WHEN {k} THEN substr(regexp_replace(regexp_extract({text}, {lit(r.pattern)}, 0), '\\s+', ' ', 'g'), 1, 24)" for k, r in enumerate(RULES)) + " END"


NAMES = "regexp_replace(lower(split_part(full_name, '/', 2)), '[-_.]+', ' ', 'g') AS name, lower(coalesce(description, '')) AS descr, array_to_string(list_transform(topics, lambda t: replace(lower(t), '-', ' ')), ', ') AS tags, lower(split_part(full_name, '/', 1)) AS owner"
TRACKED = f"""{REPO_VIEW}, t AS (SELECT *, {NAMES} FROM repos), u AS (SELECT *, name || '. ' || descr AS core FROM t),
v AS (SELECT *, {first_rule('core', list(range(len(RULES))))} AS x, CASE WHEN tags <> '' THEN {first_rule('tags', [k for k, r in enumerate(RULES) if not r.stack])} END AS y FROM u),
w AS (SELECT *, CASE WHEN coalesce(x, y, -1) <> 1 AND tags <> '' AND regexp_matches(tags, {lit(RULES[0].pattern)}) THEN 0 ELSE coalesce(x, y) END AS hit FROM v),
z AS (SELECT *, coalesce(hit = 1, FALSE) AS learn, CASE hit {' '.join(f"WHEN {k} THEN {lit(r.track)}" for k, r in enumerate(RULES))} ELSE 'ai-app' END AS base,
CASE WHEN x IS NOT NULL THEN {signal('core', 'x')} ELSE {signal('tags', 'y')} END AS s1,
nullif(CASE WHEN coalesce(hit = 1, FALSE) THEN regexp_extract(regexp_replace(descr, '^([^.!?]*[.!?])\\s.*$', '\\1'), {lit(repo_kinds.AI_WORDS)}, 0)
ELSE coalesce(nullif(regexp_extract(descr, {lit(repo_kinds.AI_WORDS)}, 0), ''), regexp_extract(tags, {lit(repo_kinds.AI_WORDS)}, 0)) END, '') AS s2, owner IN ({', '.join(map(lit, repo_kinds.LABS))}) AS lab FROM w),
tracked AS (SELECT k, full_name, description, topics, (hit IS NOT NULL AND NOT learn) OR has_paper OR s2 IS NOT NULL OR regexp_matches(name, {lit(repo_kinds.AI_NAMES)}) OR owner IN ({', '.join(map(lit, repo_kinds.AI_OWNERS))}) OR lab AS ai,
CASE WHEN base <> 'world-model' AND (has_paper OR (lab AND base IN ('infra', 'ai-app'))) THEN 'research' ELSE base END AS track, concat_ws(',', s1, CASE WHEN s2 IS DISTINCT FROM s1 THEN s2 END) AS signals, name || '. ' || descr || '. ' || tags AS whole FROM z)"""


@query("repo_tracks", f"WITH {TRACKED} SELECT k, ai, track, signals FROM tracked")
def repo_tracks(spark, d):
    return repo_kinds.with_track(repo_view(spark, d).drop("track")).select("k", "ai", "track", F.array_join("signals", ",").alias("signals"))


FUN_SQL = "CASE WHEN track IN ('research', 'infra', 'world-model', 'learn') OR regexp_matches(whole, " + lit(repo_kinds.NOT_FUN) + ") THEN NULL " + " ".join(f"WHEN regexp_matches(whole, {lit(p)}) THEN {lit(n)}" for n, p in FUN.items()) + " END"


@query("repo_fun", f"WITH {TRACKED} SELECT k, {FUN_SQL} AS fun FROM tracked")
def repo_fun(spark, d):
    rows = repo_kinds.with_track(repo_view(spark, d).drop("track"))
    return rows.select("k", repo_kinds.fun_kind(rows).alias("fun"))


MENTIONED = """names AS (SELECT 'dev' || CAST(item_id AS VARCHAR) || '/' || lower(regexp_extract(text, '[A-Za-z]{4,}', 0)) AS full_name FROM benchmark UNION SELECT lower((regexp_extract_all(text, '[A-Za-z]{4,}'))[2]) || '/' || lower((regexp_extract_all(text, '[A-Za-z]{4,}'))[1]) FROM benchmark)"""
NEWS = f"""{ITEMS}, {MENTIONED}, r AS (SELECT DISTINCT full_name, split_part(full_name, '/', 1) AS owner, split_part(full_name, '/', 2) AS name FROM names),
q AS (SELECT *, name IN ({', '.join(map(lit, news.GENERIC))}) OR length(name) < 4 OR name = owner AS generic, regexp_replace(owner, '(\\w{{4}})ai$', '\\1 ai') AS term FROM r),
m AS (SELECT q.full_name AS repo, i.id, i.published_at FROM q, items i WHERE coalesce(i.origin, '') NOT IN ('github', 'hf-papers') AND CAST(i.published_at AS TIMESTAMP) >= TIMESTAMP '2024-01-31' - INTERVAL 45 DAY
AND (regexp_matches(lower({HAY}), '\\b' || q.full_name || '\\b') OR (NOT generic AND regexp_matches(lower({HAY}), '\\b' || name || '\\b') AND ((length(name) >= 6 AND regexp_matches(name, '[0-9]')) OR (length(term) >= 3 AND term <> name AND regexp_matches(lower({HAY}), '\\b' || replace(term, ' ', '[\\s_-]?') || '\\b'))))))"""


@query("news_links", f"WITH {NEWS}, k AS (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY published_at DESC, id) AS rank FROM m) SELECT * FROM k WHERE rank <= 5")
def news_links(spark, d):
    b = tables.table(spark, d, "benchmark")
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))
    one = b.select(F.concat(F.lit("dev"), F.col("item_id").cast("string"), F.lit("/"), F.lower(F.get(words, F.lit(0)))).alias("full_name"))
    two = b.select(F.concat(F.lower(F.get(words, F.lit(1))), F.lit("/"), F.lower(F.get(words, F.lit(0)))).alias("full_name"))
    return news.matched(tables.items(spark, d), one.union(two), NOW)


STARS = "s AS (SELECT l_partkey AS repo, l_shipdate AS moment FROM lineitem), now AS (SELECT max(moment) AS now FROM s)"


@query("board_gains", f"WITH {STARS}, g AS (SELECT repo, count(*) AS known, min(moment) AS oldest, any_value(now) AS now, " + ", ".join(f"count(*) FILTER (moment >= now - INTERVAL {n} DAY) AS {p}" for p, n in boards.DAYS.items()) + " FROM s, now GROUP BY repo), t AS (SELECT *, known + (repo % 2) AS stars FROM g) SELECT repo, " + ", ".join(f"CASE WHEN known >= stars OR oldest < now - INTERVAL {n} DAY THEN {p} END AS {p}" for p, n in boards.DAYS.items()) + ", stars FROM t")
def board_gains(spark, d):
    rows = tables.table(spark, d, "lineitem").select(F.col("l_partkey").alias("repo"), F.col("l_shipdate").alias("at"))
    last = rows.agg(F.max("at").alias("now"))
    totals = rows.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).select("repo", (F.col("n") + F.col("repo") % 2).alias("stars"))
    return boards.gains(rows.join(F.broadcast(last)), F.col("now"), totals)  # one row


@query("board_momentum", f"WITH {REPO_VIEW} SELECT k, CASE WHEN daily IS NULL OR weekly IS NULL OR weekly / 7.0 < 20 THEN NULL WHEN daily > weekly / 7.0 * 1.5 THEN 'up' WHEN daily < weekly / 7.0 * 0.6 THEN 'down' END AS momentum, coalesce(weekly, 0) + coalesce(daily, 0) * 3 + coalesce(monthly, 0) / 4.0 AS hot FROM repos")
def board_momentum(spark, d):
    rows = boards.with_momentum(repo_view(spark, d))
    return rows.select("k", "momentum", boards.hot(rows).cast("double").alias("hot"))


@query("board_breakouts", f"WITH {REPO_VIEW} SELECT k, daily FROM repos WHERE daily IS NOT NULL AND list_contains(sources, 'trending') AND (weekly IS NULL OR weekly = 0 OR daily / (weekly / 7.0) >= 1.8)")
def board_breakouts(spark, d):
    return boards.breakouts(repo_view(spark, d)).select("k", "daily")


GAIN = "CASE WHEN monthly > 0 THEN 'monthly' WHEN weekly > 0 THEN 'weekly' WHEN daily > 0 THEN 'daily' WHEN weekly IS NOT NULL THEN 'weekly' WHEN daily IS NOT NULL THEN 'daily' WHEN monthly IS NOT NULL THEN 'monthly' END"


@query("board_gain_of", f"WITH {REPO_VIEW}, g AS (SELECT *, {GAIN} AS period FROM repos) SELECT k, period, CASE period WHEN 'monthly' THEN monthly WHEN 'weekly' THEN weekly WHEN 'daily' THEN daily END AS n FROM g")
def board_gain_of(spark, d):
    return repo_view(spark, d).select("k", boards.gain_of("monthly").alias("g")).select("k", "g.period", "g.n")


@query("board_period", f"WITH {REPO_VIEW} SELECT k, weekly FROM repos WHERE weekly > 0 AND fun IS NOT NULL ORDER BY weekly DESC, k LIMIT 50")
def board_period(spark, d):
    return boards.in_tab(boards.in_period(repo_view(spark, d), "weekly"), "fun").orderBy(F.desc("weekly"), "k").select("k", "weekly").limit(50)


@query("track_stats", f"WITH {REPO_VIEW}, g AS (SELECT track, count(*) AS n, CAST(sum(weekly) AS BIGINT) AS gained FROM repos WHERE weekly > 0 GROUP BY track) SELECT track, n, gained, CAST(floor(gained * 100.0 / sum(gained) OVER () + 0.5) AS BIGINT) AS share, row_number() OVER (ORDER BY gained DESC, track) AS place FROM g")
def track_stats(spark, d):
    return boards.track_stats(repo_view(spark, d), "weekly")


@query("source_mix", f"WITH {REPO_VIEW} SELECT source, count(*) AS n FROM (SELECT unnest(sources) AS source FROM repos) GROUP BY source")
def source_mix(spark, d):
    return boards.source_mix(repo_view(spark, d))


@query("tab_counts", f"WITH {REPO_VIEW}, g AS (SELECT * FROM repos WHERE daily > 0) SELECT 'all' AS tab, count(*) AS n FROM g UNION ALL SELECT 'fun', count(*) FROM g WHERE fun IS NOT NULL UNION ALL SELECT track, count(*) FROM g GROUP BY track")
def tab_counts(spark, d):
    return boards.tab_counts(repo_view(spark, d), "daily")


@query("wide_untracked", f"WITH {REPO_VIEW}, f AS (SELECT upper(full_name) AS full_name, CASE WHEN k % 9 = 0 THEN repeat('x', 301) ELSE description END AS description, k FROM repos) SELECT k FROM f WHERE length(coalesce(description, '')) <= 300 AND k % 3 <> 0")
def wide_untracked(spark, d):
    rows = repo_view(spark, d)
    found = rows.select(F.upper("full_name").alias("full_name"), F.when(F.col("k") % 9 == 0, F.repeat(F.lit("x"), 301)).otherwise(F.col("description")).alias("description"), "k")
    return boards.untracked(found, rows.where("k % 3 = 0")).select("k")


@query("repos_kept", f"WITH {REPO_VIEW} SELECT k FROM repos WHERE list_contains(sources, 'trending') OR (stars >= 50 AND (daily > 0 OR weekly > 0 OR monthly > 0))")
def repos_kept(spark, d):
    return boards.worth_keeping(repo_view(spark, d)).select("k")


@query("markup_drift", f"WITH {REPO_VIEW} SELECT count(*) AS rows, count(*) FILTER (stars % 3 = 0) AS without_stars, count(*) >= 20 AND count(*) FILTER (stars % 3 = 0) > count(*) * 0.5 AS drifted FROM repos")
def markup_drift(spark, d):
    return boards.markup_drift(repo_view(spark, d).withColumn("stars", F.when(F.col("stars") % 3 == 0, 0).otherwise(F.col("stars"))))


@query("merged_periods", "WITH r AS (SELECT l_suppkey AS k, CASE l_linenumber % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS period, l_orderkey AS stars, CAST(l_quantity AS BIGINT) AS forks, l_partkey AS gained FROM lineitem) SELECT 'o/' || CAST(k AS VARCHAR) AS key, max(stars) AS stars, max(forks) AS forks, " + ", ".join(f"max(gained) FILTER (period = '{p}') AS {p}" for p in boards.DAYS) + " FROM r GROUP BY k")
def merged_periods(spark, d):
    n = F.col("l_linenumber") % 3
    rows = tables.table(spark, d, "lineitem").select(F.concat(F.lit("O/"), F.col("l_suppkey").cast("string")).alias("full_name"), F.when(n == 0, "daily").when(n == 1, "weekly").otherwise("monthly").alias("period"), F.col("l_orderkey").alias("stars"), F.col("l_quantity").cast("long").alias("forks"), F.col("l_partkey").alias("gained"))
    return boards.merged_periods(rows).drop("full_name")


OLD = "old AS (SELECT k, 'c' || CAST(k AS VARCHAR) AS created_at, 'n' || CAST(k % 5 AS VARCHAR) AS note FROM repos WHERE k % 2 = 0)"


@query("repo_memory", f"WITH {REPO_VIEW}, {OLD} SELECT r.k, old.created_at, CASE WHEN r.k % 3 = 0 THEN 'own' ELSE old.note END AS note FROM repos r LEFT JOIN old USING (k)")
def repo_memory(spark, d):
    rows, k = repo_view(spark, d), F.col("k")
    old = rows.where("k % 2 = 0").select(F.upper("full_name").alias("full_name"), F.concat(F.lit("c"), k.cast("string")).alias("created_at"), F.concat(F.lit("n"), (k % 5).cast("string")).alias("note"))
    return boards.with_memory(rows.withColumn("note", F.when(k % 3 == 0, "own")), old).select("k", "created_at", "note")


@query("repo_overlay", f"WITH {REPO_VIEW} SELECT k, CASE WHEN k % 5 <> 0 OR k % 2 = 0 THEN stars ELSE stars + 1 END AS stars, CASE WHEN k % 5 = 0 AND (k % 2 <> 0 OR description IS NULL) THEN 'looked up' ELSE description END AS description, CASE WHEN k % 5 = 0 THEN 'new' END AS created_at FROM repos")
def repo_overlay(spark, d):
    rows = repo_view(spark, d).withColumn("created_at", F.lit(None).cast("string"))
    found = rows.where("k % 5 = 0").select("full_name", (F.col("stars") + 1).alias("stars"), F.lit("looked up").alias("description"), F.lit("new").alias("created_at"), "topics")
    return boards.overlaid(rows, found).select("k", "stars", "description", "created_at")


@query("repo_colours", f"WITH {REPO_VIEW}, c AS (SELECT language, min(language_color) AS c FROM repos WHERE language_color IS NOT NULL GROUP BY language) SELECT k, coalesce(language_color, c) AS language_color FROM repos LEFT JOIN c USING (language)")
def repo_colours(spark, d):
    return boards.with_colours(repo_view(spark, d)).select("k", "language_color")


@query("gained_since_creation", f"WITH {REPO_VIEW} SELECT k, " + ", ".join(f"CASE WHEN {p} IS NULL AND age <= {n} THEN stars ELSE {p} END AS {p}" for p, n in boards.DAYS.items()) + " FROM repos")
def gained_since_creation(spark, d):
    return boards.gained_since_creation(repo_view(spark, d), F.col("age")).select("k", *boards.DAYS)


@query("star_histories", "WITH e AS (SELECT user_id AS repo, CAST(ts AS DATE) AS date, max(event_id) AS stars FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY date DESC) AS n FROM e) SELECT repo, count(*) AS samples, strftime(min(date), '%Y-%m-%d') AS first, CAST(arg_max(stars, date) AS BIGINT) AS last FROM n WHERE n <= 10 GROUP BY repo")
def star_histories(spark, d):
    samples = tables.table(spark, d, "events").select(F.col("user_id").alias("repo"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_id").alias("stars"))
    h = F.col("history")
    return boards.histories(samples, 10).select("repo", F.size(h).cast("long").alias("samples"), h[0]["date"].alias("first"), F.element_at(h, -1)["stars"].alias("last"))


# -- notes of a language model


def turn_of(values: list[str]) -> str:
    return f"({sql_list(values)})[(conv_id + turn) % {len(values)} + 1]"


MARKED = ["Chips（#3、#7、12）rise", "Two (#5) deals , and #9 more.", "Husks （、、）stay (# ) out", "see （#1 和 #4）、。", "plain (2024) text", "a  b\t\tc 、、d"]
MARK_SQL = "@text"
for _pattern, _to in notes.REFERENCE_MARKS:
    _pattern = _pattern.replace("(?![A-Za-z0-9_])", "\\b")
    MARK_SQL = f"regexp_replace({MARK_SQL}, {lit(_pattern)}, {lit(_to.replace('$', chr(92)))}, 'g')"


@query("clean_marks", f"SELECT conv_id, turn, regexp_replace({MARK_SQL.replace('@text', "(" + turn_of(MARKED) + " || ' ' || coalesce(text, ''))")}, '^\\s+|\\s+$', '', 'g') AS text FROM conversations")
def clean_marks(spark, d):
    rows = tables.table(spark, d, "conversations")
    return rows.select("conv_id", "turn", notes.without_marks(F.concat(pick(MARKED, F.col("conv_id") + F.col("turn")), F.lit(" "), F.coalesce("text", F.lit("")))).alias("text"))


ANSWERS = ['```json\n[1, "a b"]\n```', "Here: [2, 3] as asked", '{"a": [1]}', "nothing", "[]", "[broken"]
ARRAYS = ['1,"a b"', "2,3", "1", None, "", None]


@query("json_answers", f"SELECT conv_id, turn, ({'[' + ', '.join('NULL' if a is None else lit(a.replace(chr(34), '')) for a in ARRAYS) + ']'})[(conv_id + turn) % {len(ANSWERS)} + 1] AS answer FROM conversations")
def json_answers(spark, d):
    rows = tables.table(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.array_join(notes.json_array(pick(ANSWERS, F.col("conv_id") + F.col("turn"))), ",").alias("answer"))


NOTES = ["“把网页变成命令行工具的开源项目，值得关注。”", "用一句话生成完整游戏的智能体框架；十分值得一试", "太短。", "没有句号的旧笔记被截断了", "第一句话在这里说完整。。", "Turns papers into code you can run."]
NOTE_SQL = "regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(@text, '^[\"“”'''']+|[\"“”'''']+$', '', 'g'), '\\s+', ' ', 'g')), " + lit(notes.FILLER) + ", '。'), '[，,；;、]\\s*。$', '。'), '([。！？])[。！？]+$', '\\1')"


@query("clean_notes", f"WITH n AS (SELECT conv_id, turn, {NOTE_SQL.replace('@text', "CASE WHEN (conv_id + turn) % 2 = 0 THEN regexp_extract(coalesce(text, ''), '^[^.]*[.]') ELSE " + turn_of(NOTES) + " END")} AS note FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(note, '[。！？.!?]$') AND length(note) BETWEEN 8 AND 70 THEN note END AS note FROM n")
def clean_notes(spark, d):
    rows = tables.table(spark, d, "conversations")
    k = F.col("conv_id") + F.col("turn")
    written = F.when(k % 2 == 0, F.regexp_extract(F.coalesce("text", F.lit("")), "^[^.]*[.]", 0)).otherwise(pick(NOTES, k))
    return rows.select("conv_id", "turn", notes.note(written).alias("note"))


# -- home page and reports

SEEN = f"{HEATED}, seen AS (SELECT *, published_at AS first_seen, CASE WHEN id % 3 = 0 THEN 'https://img.example/' || CAST(id AS VARCHAR) END AS image FROM heated)"


def seen(spark, d):
    return R.heated(spark, d).withColumns({"first_seen": F.col("published_at"), "image": F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://img.example/"), F.col("id").cast("string")))})


@query("home_trending", f"WITH {HEATED} SELECT id, heat FROM heated WHERE ai_selected IS NOT FALSE AND CAST(published_at AS TIMESTAMP) >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY ORDER BY heat DESC, id LIMIT 8")
def home_trending(spark, d):
    return daily.trending(R.heated(spark, d), NOW, days=30).select("id", "heat")


@query("home_hero", f"WITH {SEEN} SELECT id, heat FROM seen WHERE image IS NOT NULL AND ai_selected IS NOT FALSE ORDER BY heat DESC, published_at DESC, id LIMIT 1")
def home_hero(spark, d):
    return daily.hero(seen(spark, d)).select("id", "heat")


SMALL = "small AS (SELECT event_id AS id, event_type AS title, CASE WHEN event_id % 4 = 0 THEN 'text' END AS summary, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS published_at, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS first_seen, event_type AS category, CAST(floor(value) AS BIGINT) AS heat, CASE WHEN event_id % 5 = 0 THEN FALSE END AS ai_selected FROM events)"


def small(spark, d):
    return tables.stream_items(spark, d).select("id", F.col("category").alias("title"), F.when(F.col("id") % 4 == 0, "text").alias("summary"), "published_at", F.col("published_at").alias("first_seen"), "category", "heat", F.when(F.col("id") % 5 == 0, False).alias("ai_selected"))


@query("daily_index", f"WITH {SMALL}, x AS (SELECT *, substr(first_seen, 1, 10) AS day FROM small), c AS (SELECT day, count(*) AS n FROM x WHERE day >= '2024-01-21' GROUP BY day HAVING count(*) >= 3), l AS (SELECT day, title, row_number() OVER (PARTITION BY day ORDER BY CASE WHEN summary IS NOT NULL THEN 0 ELSE 1 END, published_at DESC, id) AS k FROM x) SELECT c.day, c.n, l.title AS lead FROM c JOIN l ON l.day = c.day AND l.k = 1")
def daily_index(spark, d):
    return daily.daily_index(small(spark, d), NOW, days=10)


@query("daily_neighbours", f"WITH {SMALL}, x AS (SELECT DISTINCT substr(first_seen, 1, 10) AS day FROM small) SELECT day, lag(day) OVER (ORDER BY day) AS previous, lead(day) OVER (ORDER BY day) AS next FROM x")
def daily_neighbours(spark, d):
    return daily.neighbours(small(spark, d).select(F.substring("first_seen", 1, 10).alias("day")).distinct())


@query("new_since", f"WITH {SMALL} SELECT count(*) AS n FROM small WHERE CAST(first_seen AS TIMESTAMP) > TIMESTAMP '2024-01-29 12:00:00'")
def new_since(spark, d):
    return daily.new_since(small(spark, d), "2024-01-29T12:00:00")


@query("today_items", f"WITH {SMALL} SELECT id FROM small WHERE CAST(first_seen AS TIMESTAMP) >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR")
def today_items(spark, d):
    return daily.fresh(small(spark, d), NOW).select("id")


@query("digest_candidates", f"WITH {SMALL}, y AS (SELECT *, ai_selected IS NOT FALSE AND epoch(TIMESTAMP '2024-01-31') - epoch(CAST(published_at AS TIMESTAMP)) < 259200 AS young FROM small), c AS (SELECT count(*) FILTER (young) >= 5 AS enough FROM y) SELECT id, heat FROM y, c WHERE young OR NOT enough ORDER BY heat DESC, id LIMIT 18")
def digest_candidates(spark, d):
    return daily.digest_candidates(small(spark, d), NOW).select("id", "heat")


@query("trend_range", f"WITH {SMALL}, x AS (SELECT substr(first_seen, 1, 10) AS day, count(*) AS n FROM small WHERE id % 3 = 0 GROUP BY 1) SELECT day, n FROM x WHERE day IN (SELECT day FROM x ORDER BY day DESC LIMIT 7)")
def trend_range(spark, d):
    return daily.last_rows(small(spark, d).where("id % 3 = 0").groupBy(F.substring("first_seen", 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("n")), 7)


@query("crawl_report", "SELECT count(DISTINCT source) AS sources, (SELECT CAST(count(*) AS BIGINT) FROM supplier WHERE s_suppkey < 7) AS errors, count(*) AS rows, TRUE AS failed FROM documents")
def crawl_report(spark, d):
    counts = tables.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    errors = tables.table(spark, d, "supplier").where("s_suppkey < 7").select(F.col("s_name").alias("source"), F.lit("HTTP 429").alias("error"))
    return daily.crawl_report(counts, errors).select(F.size("sources").cast("long").alias("sources"), F.size("errors").cast("long").alias("errors"), "rows", "failed")


@query("archive_totals", f"WITH {SMALL} SELECT substr(first_seen, 1, 7) AS month, count(*) AS n FROM small GROUP BY ROLLUP (1)")
def archive_totals(spark, d):
    return archive.totals(archive.with_month(small(spark, d)))


DAY = "x AS (SELECT * FROM small WHERE substr(first_seen, 1, 10) = '2024-01-10')"
RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY heat DESC, published_at DESC, id) AS k FROM x)"


@query("daily_report", f"WITH {SMALL}, {DAY}, {RANKED} SELECT '2024-01-10' AS day, (SELECT count(*) FROM x) AS n, (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY heat DESC, published_at DESC, id) FROM (SELECT * FROM x WHERE ai_selected IS NOT FALSE ORDER BY heat DESC, published_at DESC, id LIMIT 6)) AS featured, (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY category, k) FROM r WHERE k <= 5) AS sections, (SELECT count(*) FROM r WHERE k <= 5) AS section_items, (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY published_at DESC, id) FROM (SELECT * FROM x ORDER BY published_at DESC, id LIMIT 6)) AS flashes")
def daily_report(spark, d):
    one = daily.daily_report(small(spark, d), "2024-01-10", R.CATEGORIES)
    join = lambda c: F.array_join(c, ",")
    return one.select("day", "n", join("featured").alias("featured"), join(F.flatten(F.col("sections.items"))).alias("sections"), daily.section_sizes(F.col("sections")).cast("long").alias("section_items"), join("flashes").alias("flashes"))


# -- stories and search


@query("story_status", f"{R.STORIES}, n AS (SELECT status, count(*) AS n FROM told GROUP BY status) SELECT s.status, coalesce(n.n, 0) AS n FROM (SELECT unnest(['developing', 'new', 'settled']) AS status) s LEFT JOIN n USING (status) UNION ALL SELECT 'all', count(*) FROM told")
def story_status(spark, d):
    return stories.status_counts(R.told(spark, d))


@query("story_focus", f"{R.ALL_STORIES} SELECT story, n_sources, heat FROM told WHERE status <> 'settled' ORDER BY n_sources DESC, heat DESC, story LIMIT 2")
def story_focus(spark, d):
    return stories.focus(R.told(spark, d, every=True)).select("story", "n_sources", "heat")


@query("search_fuzzy")
def search_fuzzy(spark, d):
    rows = tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"), F.col("p_brand").alias("source"))
    return search.fuzzy_found(rows, "smal widg ring", 50)


SOFT = [search.Group(("widget", "gear")), search.Group(("small", "hot"), soft=True)]


@query("search_soft", f"WITH {R.PARTS}, h AS (SELECT id, CASE WHEN regexp_matches(name, '(^|[^a-z0-9])(widget|gear)') THEN 5 ELSE 0 END AS h0, greatest(CASE WHEN regexp_matches(name, '(^|[^a-z0-9])(small|hot)') THEN 5 ELSE 0 END, CASE WHEN regexp_matches(lower(track), '(^|[^a-z0-9])(small|hot)') THEN 1 ELSE 0 END) AS h1 FROM parts), c AS (SELECT count(*) AS n, count(*) FILTER (h0 > 0) AS d0, count(*) FILTER (h1 > 0) AS d1 FROM h), s AS (SELECT id, round(ln(1 + n / (1 + d0)) * h0 + ln(1 + n / (1 + d1)) * 0.4 * h1, 6) AS score FROM h, c WHERE d0 > 0 AND h0 > 0) SELECT id, score FROM s WHERE score > 0 AND score >= 0.5 * (SELECT max(score) FROM s)")
def search_soft(spark, d):
    return search.concept_ranked(R.parts(spark, d), SOFT, {"name": 5, "track": 1})


# -- weekly reports, the palette and pictures

WEEKLY = f"{SMALL}, wk AS (SELECT * FROM small WHERE substr(published_at, 1, 10) BETWEEN '2024-01-15' AND '2024-01-21')"


def week(spark, d):
    return small(spark, d).where(F.substring("published_at", 1, 10).between("2024-01-15", "2024-01-21")).withColumn("ai_note", F.when(F.col("id") % 7 == 0, F.concat(F.lit("note "), F.col("id").cast("string"), F.lit("。"))))


@query("weekly_sources", "SELECT CAST(user_id AS VARCHAR) AS source, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-01-21' GROUP BY 1 ORDER BY n DESC, source LIMIT 8")
def weekly_sources(spark, d):
    return weekly.top_sources(R.week_items(spark, d))


KINDS = ["view", "nothing", "click", "purchase", "error", "signup"]
BROKEN_DOWN = f"{WEEKLY}, b AS (SELECT CAST(i AS INTEGER) AS place, ({sql_list(KINDS)})[i + 1] AS category, (SELECT count(*) FROM wk WHERE wk.category = ({sql_list(KINDS)})[i + 1]) AS n FROM range({len(KINDS)}) t(i))"


@query("weekly_categories", f"WITH {BROKEN_DOWN} SELECT * FROM b")
def weekly_categories(spark, d):
    return weekly.category_breakdown(week(spark, d), KINDS)


@query("weekly_best_category", f"WITH {BROKEN_DOWN} SELECT category, n FROM b ORDER BY n DESC, place LIMIT 1")
def weekly_best_category(spark, d):
    return weekly.best_category(week(spark, d), KINDS)


NOTED = f"{WEEKLY}, o AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'note ' || CAST(id AS VARCHAR) || '。' END AS ai_note, row_number() OVER (PARTITION BY category ORDER BY heat DESC, published_at DESC, id) AS k FROM wk)"


@query("weekly_section_summaries", f"WITH {NOTED}, f AS (SELECT category, count(*) AS n, list(title ORDER BY k) AS t, list(ai_note ORDER BY k) FILTER (ai_note IS NOT NULL) AS a FROM o WHERE k <= 5 GROUP BY category) SELECT category, n, CASE WHEN len(a) > 0 THEN array_to_string(a[1:2], '；') ELSE '本周' || CASE category WHEN 'view' THEN '浏览' ELSE category END || '方向共 ' || CAST(n AS VARCHAR) || ' 条动态，重点包括：' || array_to_string(t[1:3], '、') || '。' END AS summary FROM f")
def weekly_section_summaries(spark, d):
    return weekly.section_summaries(week(spark, d), {"view": "浏览"})


@query("weekly_top_summary", f"WITH {NOTED}, r AS (SELECT *, row_number() OVER (ORDER BY heat DESC, id) AS rank FROM o), p AS (SELECT * FROM r WHERE rank <= 10), n AS (SELECT list(regexp_replace(ai_note, '[。；！？.;!?]+$', '') ORDER BY rank) FILTER (ai_note IS NOT NULL) AS a, list(title ORDER BY rank) AS t FROM p) SELECT CASE WHEN len(a) >= 2 THEN array_to_string(a[1:3], '；') || '。' ELSE '本周共收录 ' || CAST((SELECT count(*) FROM wk) AS VARCHAR) || ' 条资讯，热度最高的包括「' || array_to_string(t[1:3], '」「') || '」。' END AS summary FROM n")
def weekly_top_summary(spark, d):
    rows = week(spark, d)
    top = rows.orderBy(*R.by_heat()).limit(10).withColumn("rank", F.row_number().over(Window.orderBy(*R.by_heat())))
    return weekly.top_summary(top, rows.agg(F.count(F.lit(1)).alias("n")))


@query("weekly_insight", f"WITH {R.STREAM}, w AS (SELECT strftime(date_trunc('week', CAST(day AS DATE)), '%Y-%m-%d') AS week, count(*) AS total FROM stream GROUP BY 1) SELECT week, total, CASE WHEN substr(week, 9, 2) <> '08' THEN 'insight of ' || week END AS insight FROM w")
def weekly_insight(spark, d):
    weeks = R.stream(spark, d).groupBy(trends.week(F.col("day")).alias("week")).agg(F.count(F.lit(1)).alias("total"))
    notes_ = weeks.select(F.concat("week", F.lit(" ~ later")).alias("label"), F.when(F.col("week").endswith("-08"), "").otherwise(F.concat(F.lit("insight of "), "week")).alias("insight"))
    return weekly.with_insight(weeks, notes_)


@query("poster_picks", f"WITH {SMALL} SELECT id, heat FROM small WHERE substr(first_seen, 1, 10) = '2024-01-20' AND ai_selected IS NOT FALSE ORDER BY heat DESC, id LIMIT 5")
def poster_picks(spark, d):
    return weekly.poster_picks(small(spark, d).withColumn("origin", F.lit("x")), "2024-01-20").select("id", "heat")


@query("command_palette", "SELECT 'category' AS kind, 'k1' AS id, 'news 1' AS label UNION ALL SELECT * FROM (SELECT 'source', source, source FROM (SELECT 's1-' || source AS source, count(*) AS n FROM documents GROUP BY 1) ORDER BY n DESC, source LIMIT 8)")
def command_palette(spark, d):
    categories = spark.createDataFrame([("k1", "news 1"), ("k2", "other")], "key string, label string")
    sources = tables.table(spark, d, "documents").groupBy(F.concat(F.lit("s1-"), "source").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    none = spark.createDataFrame([], "id long, title string, score double")
    return weekly.palette("1", categories, sources, none)


# -- small functions of items


@query("source_slots", "SELECT DISTINCT source, CAST(abs(list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(source, ''), lambda c: CAST(ord(c) AS HUGEINT))), lambda h, x: ((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)) % 10 AS INTEGER) AS slot FROM (SELECT source || ' and longer text' AS source FROM documents)")
def source_slots(spark, d):
    rows = tables.table(spark, d, "documents").select(F.concat("source", F.lit(" and longer text")).alias("source")).distinct()
    return rows.select("source", T.hash_slot(F.col("source")).alias("slot"))


@query("item_ids", "SELECT page_id, 'rss:x-' || substr(sha1(url), 1, 10) AS id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host FROM pages")
def item_ids(spark, d):
    return tables.table(spark, d, "pages").select("page_id", T.source_id(F.lit("rss:x"), F.col("url")).alias("id"), T.host(F.col("url")).alias("host"))


BJ = "CAST(published_at AS TIMESTAMP) + INTERVAL 8 HOUR"


@query("item_times", f"WITH {R.STREAM} SELECT id, CASE WHEN hour({BJ}) < 6 THEN '凌晨' WHEN hour({BJ}) < 12 THEN '上午' WHEN hour({BJ}) < 18 THEN '下午' ELSE '晚上' END || strftime({BJ}, ' %H:%M') AS clock, CASE WHEN epoch(TIMESTAMP '2024-01-31') - epoch(CAST(published_at AS TIMESTAMP)) < 60 THEN '刚刚' WHEN epoch(TIMESTAMP '2024-01-31') - epoch(CAST(published_at AS TIMESTAMP)) < 3600 THEN CAST(CAST(floor((epoch(TIMESTAMP '2024-01-31') - epoch(CAST(published_at AS TIMESTAMP))) / 60) AS BIGINT) AS VARCHAR) || ' 分钟前' WHEN CAST({BJ} AS DATE) = DATE '2024-01-31' THEN CAST(CAST(floor((epoch(TIMESTAMP '2024-01-31') - epoch(CAST(published_at AS TIMESTAMP))) / 3600) AS BIGINT) AS VARCHAR) || ' 小时前' WHEN CAST({BJ} AS DATE) = DATE '2024-01-30' THEN '昨天' ELSE strftime({BJ}, '%-m/%-d %H:%M') END AS relative FROM stream")
def item_times(spark, d):
    at = F.col("published_at")
    return R.stream(spark, d).select("id", times.clock(at).alias("clock"), times.relative(at, F.lit(NOW)).alias("relative"))


@query("item_blurbs", "SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'a note' WHEN length(t) > 60 THEN substr(t, 1, 58) || '…' ELSE t END AS blurb FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM conversations)")
def item_blurbs(spark, d):
    return tables.table(spark, d, "conversations").select("conv_id", "turn", T.blurb(F.when(F.col("turn") % 5 == 0, "a note"), F.coalesce("text", F.lit(""))).alias("blurb"))


@query("feed_document", f"WITH {TITLED}, t AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, id) AS place FROM titled) SELECT place, '<item><title>' || {R.XML.format('title')} || '</title><link>' || {R.XML.format(chr(99) + 'oalesce(source_url, ' + chr(39) * 2 + ')')} || '</link><guid isPermaLink=\"false\">' || CAST(id AS VARCHAR) || '</guid><source>' || source || '</source><pubDate>' || strftime(CAST(published_at AS TIMESTAMP), '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate><description>' || {R.XML.format('CASE WHEN id % 2 = 0 THEN ' + lit('a <note>') + ' ELSE title END')} || '</description></item>' AS entry FROM t WHERE place <= 30")
def feed_document(spark, d):
    rows = titled(spark, d).withColumns({"ai_note": F.when(F.col("id") % 2 == 0, "a <note>"), "summary": F.lit(None).cast("string")})
    return exports.feed_entries(rows, NOW)


@query("list_document", f"WITH {SMALL}, t AS (SELECT id, '<' || title AS title FROM small ORDER BY heat DESC, id LIMIT 20) SELECT '[' || string_agg('{{\"id\":' || CAST(id AS VARCHAR) || ',\"title\":\"\\u003c' || title[2:] || '\"}}', ',') || ']' AS document FROM t")
def list_document(spark, d):
    rows = small(spark, d).withColumn("title", F.concat(F.lit("<"), "title"))
    return exports.list_document(rows, ["id", "title"], R.by_heat())


@query("sources_list", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def sources_list(spark, d):
    return exports.sources_list(tables.table(spark, d, "documents"))


LOOSE = "loose AS (SELECT CASE WHEN c_custkey % 7 <> 0 THEN repeat('i', 150) || '-' || CAST(c_custkey AS VARCHAR) || repeat('x', 60) END AS id, CASE WHEN c_custkey % 11 = 0 THEN '   ' ELSE '  ' || c_name || ' ' END AS title, c_mktsegment AS source, CASE c_custkey % 5 WHEN 0 THEN 'javascript:x' WHEN 1 THEN 'http://a.example/' || CAST(c_custkey AS VARCHAR) ELSE ' https://a.example/' || CAST(c_custkey AS VARCHAR) END AS url, c_acctbal AS heat FROM customer)"


def loose(spark, d):
    k = F.col("c_custkey")
    url = F.when(k % 5 == 0, "javascript:x").when(k % 5 == 1, F.concat(F.lit("http://a.example/"), k.cast("string"))).otherwise(F.concat(F.lit(" https://a.example/"), k.cast("string")))
    return tables.table(spark, d, "customer").select(
        F.when(k % 7 != 0, F.concat(F.repeat(F.lit("i"), 150), F.lit("-"), k.cast("string"), F.repeat(F.lit("x"), 60))).alias("id"), F.when(k % 11 == 0, "   ").otherwise(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("title"), F.lit(None).cast("string").alias("summary"),
        F.col("c_mktsegment").alias("source"), url.alias("source_url"), url.alias("image"), F.col("c_acctbal").alias("heat"), F.lit(None).cast("double").alias("engagement"), F.array(F.lit(" "), F.lit(" tag ")).alias("tags"), F.lit("not a time").alias("published_at"),
    )


@query("sanitize_all", f"WITH {LOOSE} SELECT substr(id, 1, 200) AS id, trim(title) AS title, trim(url) AS source_url, CASE WHEN trim(url) LIKE 'https://%' THEN trim(url) END AS image, CASE WHEN heat >= 0 THEN CAST(floor(heat + 0.5) AS BIGINT) ELSE 0 END AS heat, 'tag' AS tags, CAST(NULL AS VARCHAR) AS published_at FROM loose WHERE id IS NOT NULL AND trim(title) <> '' AND url <> 'javascript:x'")
def sanitize_all(spark, d):
    return classify.sanitised(loose(spark, d)).select("id", "title", "source_url", "image", "heat", F.array_join("tags", ",").alias("tags"), "published_at")


@query("sanitize_dropped", f"WITH {LOOSE}, k AS (SELECT count(*) AS kept FROM loose WHERE id IS NOT NULL AND trim(title) <> '' AND url <> 'javascript:x') SELECT kept, (SELECT count(*) FROM loose) - kept AS dropped FROM k")
def sanitize_dropped(spark, d):
    return classify.dropped(loose(spark, d))


@query("pool_first_wins", f"WITH {R.HALVES} SELECT id, heat FROM a UNION ALL SELECT id, heat FROM b WHERE id NOT IN (SELECT id FROM a)")
def pool_first_wins(spark, d):
    return state.first_wins(*R.halves(spark, d)).select("id", "heat")


@query("pool_last_wins", f"WITH {R.HALVES} SELECT id, heat FROM b UNION ALL SELECT id, heat FROM a WHERE id NOT IN (SELECT id FROM b)")
def pool_last_wins(spark, d):
    return state.last_wins(*R.halves(spark, d)).select("id", "heat")


@query("archive_or_current", f"WITH {R.HALVES} SELECT id, heat FROM b")
def archive_or_current(spark, d):
    old, new = R.halves(spark, d)
    return state.either(old.where("heat < 0"), new).select("id", "heat")


@query("notes_budget", f"WITH {SMALL} SELECT id FROM small WHERE id % 4 <> 0 ORDER BY heat DESC, id LIMIT 30")
def notes_budget(spark, d):
    return state.to_enrich(small(spark, d), "summary", R.by_heat(), 30).select("id")


@query("candidate_merge", "WITH r AS (SELECT p_partkey AS n, 'N' || CAST(p_partkey AS VARCHAR) AS name FROM part) SELECT name AS full_name, CASE WHEN n % 2 = 0 THEN n ELSE n + 100 END AS stars, CASE WHEN n % 2 = 0 AND n % 3 = 0 THEN 'paper,trending' WHEN n % 2 = 0 THEN 'trending' ELSE 'paper' END AS sources FROM r WHERE n % 2 = 0 OR n % 3 = 0")
def candidate_merge(spark, d):
    n, rows = F.col("p_partkey"), tables.table(spark, d, "part")
    name = F.concat(F.lit("N"), n.cast("string"))
    one = rows.where(n % 2 == 0).select(name.alias("full_name"), n.alias("stars"), F.lit("x").alias("description"))
    two = rows.where(n % 3 == 0).select(F.when(n % 2 == 0, F.lower(name)).otherwise(name).alias("full_name"), (n + 100).alias("stars"), F.lit("y").alias("description"))
    return repos.merged_candidates([("trending", one), ("paper", two)]).select("full_name", "stars", F.array_join("sources", ",").alias("sources"))


@query("snapshot_meta", "SELECT '2024-01-31T00:00:00' AS fetched_at, (SELECT count(*) FROM documents) AS count, string_agg(source || '=' || CAST(n AS VARCHAR), ',' ORDER BY source) AS sources FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def snapshot_meta(spark, d):
    one = snapshots.meta_of(tables.table(spark, d, "documents"), NOW)
    entries = F.transform(F.array_sort(F.map_entries("sources")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return one.select("fetched_at", "count", F.array_join(entries, ",").alias("sources"))


@query("repo_snapshot", f"WITH {REPO_VIEW}, s AS (SELECT source, count(*) AS n FROM (SELECT unnest(sources) AS source FROM repos) GROUP BY source) SELECT '{NOW}' AS fetched_at, '2023-12-01' AS started_at, (SELECT count(*) FROM repos) AS count, string_agg(source || '=' || CAST(n AS VARCHAR), ',' ORDER BY source) AS by_source FROM s")
def repo_snapshot(spark, d):
    old = spark.createDataFrame([("2023-12-01",)], "started_at string")
    one = snapshots.repo_snapshot(repo_view(spark, d), NOW, old)
    entries = F.transform(F.array_sort(F.map_entries("by_source")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return one.select("fetched_at", "started_at", "count", F.array_join(entries, ",").alias("by_source"))


SEEDS = [("First", "one", "tip"), ("Second", "two", "paper"), ("Third", "three", "industry")]


@query("sample_items", f"SELECT 'mock-' || lpad(CAST(i + 1 AS VARCHAR), 4, '0') AS id, (['First', 'Second', 'Third'])[i % 3 + 1] || CASE WHEN i >= 3 THEN ' (' || CAST(i // 3 + 1 AS VARCHAR) || ')' ELSE '' END AS title, strftime(TIMESTAMP '{NOW}' - to_hours(CAST(i * 3 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.000Z') AS published_at, greatest(25, 95 - i + ((i * 13 + 7) % 10)) AS heat, i % 3 <> 0 AS ai_selected FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)")
def sample_items(spark, d):
    order = F.row_number().over(Window.orderBy("p_partkey")) - 1
    ids = tables.table(spark, d, "part").select(order.cast("long").alias("id"))
    return snapshots.sample_items(ids, SEEDS, [("a", "https://a"), ("b", "https://b")], NOW).select("id", "title", "published_at", "heat", "ai_selected")


@query("near_duplicates")
def near_duplicates(spark, d):
    rows = tables.items(spark, d).select("id", "title", "summary", "ai_selected", "engagement", "published_at")
    return dedupe.collapse_near_dups(rows).select("id")


@query("distinct_tags", f"WITH {R.TAGGED} SELECT count(DISTINCT tag) AS tags FROM tagged")
def distinct_tags(spark, d):
    return R.tagged(spark, d).select(F.explode("tags").alias("tag")).agg(F.count_distinct("tag").alias("tags"))


@query("near_tokens", f"WITH {ITEMS} SELECT DISTINCT id, unnest(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9.-]{{2,}}')) AS token FROM items")
def near_tokens(spark, d):
    return tables.items(spark, d).select("id", F.explode(dedupe.near_tokens(F.col("title"))).alias("token"))


@query("new_badges", f"WITH {R.STREAM} SELECT id, epoch(TIMESTAMP '2024-01-31') - epoch(CAST(published_at AS TIMESTAMP)) < 86400 AS new, floor((epoch(TIMESTAMP '2024-01-31') - epoch(CAST(published_at AS TIMESTAMP))) / 86400) <= 60 AS young, CAST(floor((epoch(TIMESTAMP '2024-01-31') - epoch(CAST(published_at AS TIMESTAMP))) / 86400) AS BIGINT) AS age FROM stream")
def new_badges(spark, d):
    at, now = F.col("published_at"), F.lit(NOW)
    return R.stream(spark, d).select("id", times.is_new(at, now).alias("new"), times.is_young(at, now).alias("young"), times.age_days(at, now).alias("age"))


@query("rag_context", f"WITH {R.STREAM}, t AS (SELECT id, category, source, heat, row_number() OVER (ORDER BY heat DESC, id) AS n FROM stream ORDER BY heat DESC, id LIMIT 15) SELECT id, '[' || CAST(n AS VARCHAR) || '] ' || category || ' (' || source || ')' AS line FROM t")
def rag_context(spark, d):
    rows = R.stream(spark, d).orderBy(*R.by_heat()).limit(15)
    return search.context_lines(rows.select("id", F.col("category").alias("title"), "source", F.col("heat").alias("score")))


@query("home_feed", f"WITH {TITLED}, {R.REPOS.replace(R.PARTS + ', ', '')}, m AS (SELECT *, CASE WHEN weekly IS NOT NULL THEN 'weekly' WHEN daily IS NOT NULL THEN 'daily' ELSE 'monthly' END AS period, coalesce(weekly, daily, monthly) AS gained, row_number() OVER (PARTITION BY url ORDER BY ord DESC) AS n FROM repos), c AS (SELECT *, {CASCADE} AS class FROM titled) SELECT c.id, c.class AS category, CASE WHEN m.gained > 0 THEN m.full_name END AS repo FROM c LEFT JOIN m ON m.n = 1 AND m.url = lower(regexp_replace(regexp_replace(c.source_url, '[#?].*$', ''), '/+$', ''))")
def home_feed(spark, d):
    page = F.col("page_id")
    found = tables.table(spark, d, "pages").select(F.concat(F.lit("r"), page.cast("string")).alias("full_name"), repos.plain_url(F.col("url")).alias("url"), page.alias("ord"), F.when(page % 3 == 0, page % 7).alias("weekly"), F.when(page % 2 == 0, page % 5).alias("daily"), (page % 11).alias("monthly"))
    none = spark.createDataFrame([], "full_name string, ord long, id long")
    return repos.with_trend(taxonomy.with_category(titled(spark, d)), found, none).select("id", "category", "repo")
