"""Catalogues, boards, news, notes, feeds, stories and search on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tidewire.functions import notes
from tidewire.operators import boards, daily, dedupe, news, repo_kinds, search, state, stories, taxonomy
from tidewire.sources import archive, feeds
from tidewire.functions import text as T

REPO = "full_name string, description string, topics array<string>, has_paper boolean"


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tracks_of_repositories(spark):
    cases = [
        ("lab/dreamer", "A world model for robot learning", [], False, "world-model", True),
        ("x/go-course", "A course on Go for beginners", [], False, "learn", False),
        ("x/llm-course", "A course on LLMs from scratch", [], False, "learn", True),
        ("x/life", "A guide to life. It lists AI among other things", [], False, "learn", False),
        ("x/memory-box", "Memory layer for Claude Code agents", [], False, "agent-framework", True),
        ("someone/skills", "Useful things", [], False, "mcp-tools", True),
        ("x/tool", "An MCP server for coding agents", [], False, "mcp-tools", True),
        ("x/helper", "The agent that reviews your code", [], False, "coding-agent", True),
        ("x/fast", "Quantized inference in C", [], False, "infra", True),
        ("nvlabs/fast", "Quantized inference in C", [], False, "research", True),
        ("x/fast", "Quantized inference in C", [], True, "research", True),
        ("x/thing", "Nothing to see", ["pytorch"], False, "ai-app", False),
        ("x/thing", "Nothing to see", ["world-models"], False, "world-model", True),
        ("x/list", "Awesome list of AI papers", ["world-models"], False, "learn", True),
        ("x/csv", "A CSV parser", ["cli"], False, "ai-app", False),
        ("openai/csv", None, None, False, "ai-app", True),
        ("x/v2ray-agent", "Proxy scripts", [], None, "ai-app", False),
    ]
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], f"i int, {REPO}")
    got = {r.i: r for r in repo_kinds.with_track(rows).collect()}
    assert [(got[i].track, got[i].ai) for i in range(len(cases))] == [c[4:] for c in cases]
    assert got[4].signals == ["memory layer", "claude"] and len(got[0].signals) <= 4


def test_playful_kinds(spark):
    cases = [
        ("a/npc", "A game with NPCs", "ai-app", "game"),
        ("a/x", "song covers by machine", "ai-app", "music"),
        ("a/x", "a desktop pet", "ai-app", "companion"),
        ("a/x", "game benchmark", "research", None),
        ("a/x", "face swap game", "ai-app", None),
        ("a/x", "a parser", "ai-app", None),
    ]
    rows = spark.createDataFrame([(i, *c[:2], [], c[2]) for i, c in enumerate(cases)], "i int, full_name string, description string, topics array<string>, track string")
    got = {r.i: r.k for r in rows.select("i", repo_kinds.fun_kind(rows).alias("k")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_news_of_repositories(spark):
    items = [
        ("link", "Show HN", None, "https://github.com/acme/ax", "hackernews", "2026-09-25"),
        ("full", "We tried acme/ax today", None, "https://x", "rss:a", "2026-09-24"),
        ("vendor", "Google ships TurboWriter", "new", "https://x", "rss:a", "2026-09-26"),
        ("plain", "The ax fell", None, "https://x", "rss:a", "2026-09-26"),
        ("own", "acme/ax", None, "https://github.com/acme/ax", "github", "2026-09-26"),
        ("old", "acme/ax", None, "https://x", "rss:a", "2026-05-01"),
        ("paper", "A paper clip maximiser", None, "https://x", "rss:a", "2026-09-26"),
        ("clip", "Paperclip AI raises money for paperclip", None, "https://x", "rss:a", "2026-09-26"),
        ("mono", "Research at google-research", None, "https://x", "rss:a", "2026-09-26"),
        ("two", "Tencent's hunyuan_video is out", None, "https://x", "rss:a", "2026-09-26"),
    ]
    rows = spark.createDataFrame(items, "id string, title string, summary string, source_url string, origin string, published_at string")
    names = ["acme/ax", "Google/TurboWriter", "paperclipai/paperclip", "google-research/google-research", "Tencent/hunyuan-video", "nobody/longname"]
    got = news.matched(rows, spark.createDataFrame([(n,) for n in names], "full_name string"), "2026-09-29T00:00:00").collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.repo, []).append(r.id)
    assert by == {"acme/ax": ["link", "full"], "google/turbowriter": ["vendor"], "paperclipai/paperclip": ["clip"], "tencent/hunyuan-video": ["two"], "google-research/google-research": []} or by == {"acme/ax": ["link", "full"], "google/turbowriter": ["vendor"], "paperclipai/paperclip": ["clip"], "tencent/hunyuan-video": ["two"]}


def test_marks_answers_notes_and_tags(spark):
    assert column(spark, ["好（#3、#7、12）。", "a (#5) b", "x （、、）y", "see #4b and (2024)", None], notes.without_marks) == ["好。", "a b", "x y", "see #4b and (2024)", None]
    got = column(spark, ['```json\n[{"a": 1}, "b"]\n```', "so: [1, 2] ok", '{"a": 1}', "none", None], notes.json_array)
    assert got[0] == ['{"a":1}', "b"] and got[1:] == [["1", "2"], None, None, None]
    stored = ["“把网页变成命令行工具的开源项目，值得关注。”", "没有句号的旧笔记在这里被截断", "太短。", "", None]
    assert column(spark, stored, notes.note) == ["把网页变成命令行工具的开源项目。", None, None, None, None]
    fresh = ["一个没有句号的新笔记在这里", "长" * 30 + "，" + "短" * 60, "长" * 90]
    assert column(spark, fresh, lambda c: notes.note(c, fresh=True)) == ["一个没有句号的新笔记在这里。", "长" * 30 + "。", None]
    answer = 'ok ```{"Owner/Name": ["界面设计", "AI", "界面设计", "x", 3, "“RAG”", "' + "长" * 20 + '"], "b/c": "no"}```'
    rows = spark.createDataFrame([(answer, "owner/name"), (answer, "b/c"), (answer, "d/e"), ("nothing", "a/b")], "a string, n string")
    assert [r.t for r in rows.select(notes.tags_of(F.col("a"), F.col("n")).alias("t")).collect()] == [["界面设计", "RAG"], None, None, None]
    assert column(spark, ["a (#1)", "a", None], notes.to_rewrite) == [True, False, False]
    assert [(s.title, s.body) for s in column(spark, ["intro\n## One\n- a\n### deep\n## Two\nb"], notes.sections)[0]] == [("", "intro"), ("One", "- a\n### deep"), ("Two", "b")]


def test_references_are_decoded_in_one_pass(spark):
    texts = ["a &amp;lt; b", "&#65;&#x42;&#x1F600;", "&NBSP;x", "&unknown; &#0; &#xD800;", "plain", "&rsquo;&middot;", "&amp", None]
    assert column(spark, texts, T.decode_references) == ["a &lt; b", "AB😀", " x", "&unknown; &#0; &#xD800;", "plain", "’·", "&amp", None]


def test_feeds_of_three_kinds(spark):
    rss = '<rss xmlns:media="m"><channel><item><title>First long title - The Paper</title><link>http://a/1</link><description><![CDATA[<p>hi &amp; <img src="//i.example/1.png"></p>]]></description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>No link</title></item><item><title>Guid</title><guid isPermaLink="false">http://a/2</guid><description>点击查看原文</description><enclosure url="http://e/2.mp3" type="audio/mpeg"/><media:content url="http://m.example/2.jpg"/></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">About LLM</title><link rel="self" href="http://s"/><link rel="alternate" href="http://alt"/><summary type="html">sum</summary><updated>2024-01-02T03:04:05+01:00</updated></entry><entry><title>Cooking</title><link href="http://c"/></entry></feed>'
    rdf = '<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><item><title>R</title><link>http://r/1</link><dc:date>2024-01-02 10:00:00 +0800</dc:date><image><url>https://static.36kr.com/x.png</url></image></item></rdf:RDF>'
    rows = [("f1", "One", rss, "industry", False, True), ("f2", "Two", atom, "tip", True, False), ("f3", "Three", rdf, "paper", False, False), ("f4", "Four", "no feed", "tip", False, False), ("f5", "Five", None, None, None, None)]
    frame = spark.createDataFrame(rows, "feed string, source string, body string, category string, ai_only boolean, strip_source boolean")
    got = {r.source_url: r for r in feeds.feed_items(frame).collect()}
    assert set(got) == {"http://a/1", "http://a/2", "http://alt", "http://r/1"}
    a = got["http://a/1"]
    assert (a.title, a.summary, a.published_at, a.image, a.category, a.origin) == ("First long title", "hi &", "2024-01-01T10:00:00.000Z", "https://i.example/1.png", "industry", "f1")
    assert got["http://a/2"].summary is None and got["http://a/2"].image == "http://m.example/2.jpg" and got["http://a/2"].published_at is None
    assert got["http://alt"].published_at == "2024-01-02T02:04:05.000Z" and got["http://r/1"].published_at == "2024-01-02T02:00:00.000Z" and got["http://r/1"].image is None
    assert a.id.startswith("f1-") and len(a.id) == 13


def items(spark, rows):
    return spark.createDataFrame([(i, t, s, p, h) for i, (t, s, p, h) in enumerate(rows)], "id int, title string, source string, published_at string, heat int").withColumn("summary", F.lit(None).cast("string"))


def test_stories_with_veto_pool_and_order(spark):
    day = "2026-07-{}T10:00:00"
    rows = [
        ("OpenAI 发布新模型", "A", day.format(20), 10), ("Anthropic 发布新模型", "B", day.format(20), 10),
        ("Startup settlement reached over music rights", "OpenAI", day.format(19), 30), ("Music rights settlement reached by startup", "C", day.format(20), 50), ("Court: settlement reached, music rights startup", "D", day.format(21), 20),
        ("Old quantum widget breakthrough announced", "A", day.format("01"), 1), ("Quantum widget breakthrough announced again", "B", day.format("01"), 1),
        ("Lone rocket launch window opens", "A", day.format(21), 1), ("Rocket launch window opens lone", "A", day.format(21), 1),
    ]
    got = stories.stories(items(spark, rows)).collect()
    assert [(r.story, r.title, r.n_items, r.n_sources, r.n_first_party, r.span_days, r.heat, r.status) for r in got] == [(2, rows[3][0], 3, 3, 1, 3, 50, "developing")]
    assert stories.stories(items(spark, rows[5:7])).collect()[0].status == "new"
    assert stories.stories(items(spark, rows[5:7]), "2026-07-05T00:00:00").collect()[0].status == "settled"
    told = stories.stories(items(spark, rows))
    assert {r.status: r.n for r in stories.status_counts(told).collect()} == {"developing": 1, "new": 0, "settled": 0, "all": 1}
    assert stories.chosen(told, "new").count() == 0 and stories.focus(told).count() == 1 and [r.story for r in stories.ordered(told).collect()] == [2]
    assert column(spark, ["a:b/c"], stories.poster_name) == ["story-a_b_c.png"]
    members = spark.createDataFrame([(1, "A", 1, 10), (1, "B", 2, 11), (1, "A", 3, 12)], "story int, source string, at long, id int")
    assert [(r.source, r.id) for r in stories.story_sources(members).orderBy("place").collect()] == [("A", 12), ("B", 11)]


def test_tokens_of_single_characters_and_plus_signs(spark):
    got = column(spark, ["GPT-6 发 布会 c++ the x"], T.story_tokens)[0]
    assert set(got) == {"gpt-6", "发", "布会"}


def test_rows_without_url_and_repeated_new_rows(spark):
    rows = spark.createDataFrame([(1, None, "x", True, 3), (2, "", "x", True, 3), (3, "http://h/p?a", "s", None, None), (4, "https://H/p/", None, None, 9)], "id int, source_url string, summary string, ai_selected boolean, engagement int")
    assert [(r.id, r.place) for r in dedupe.by_url(rows).collect()] == [(3, 3)]
    old = spark.createDataFrame([(1, "old", "2024-01-01")], "id int, v string, published_at string")
    new = spark.createDataFrame([(1, "b", "2024-01-02"), (1, "c", "2024-01-03"), (2, "d", None)], "id int, v string, published_at string")
    assert sorted((r.id, r.v) for r in archive.upserted(old, new).collect()) == [(1, "c"), (2, "d")]
    prev = spark.createDataFrame([(1, "2024", "kept")], "id int, first_seen string, ai_note string")
    cur = spark.createDataFrame([(1, None), (2, "own")], "id int, ai_note string")
    assert sorted((r.id, r.first_seen, r.ai_note) for r in state.with_history(cur, prev, "now").collect()) == [(1, "2024", "kept"), (2, "now", "own")]


WORDS = search.Dictionary(
    concepts=[["设计", "design"], ["界面", "前端", "ui", "frontend"], ["智能体", "agent"], ["记忆", "memory"], ["翻译", "translat"], ["本地", "离线", "local", "offline"]],
    soft=[["优化", "optimiz"]], noise=frozenset(["ai", "相关", "的", "项目", "the", "for"]), whole={"translat": "translation"},
)


def test_queries_become_concepts(spark):
    got = search.concepts_of("优化 AI 设计 UI 相关的项目", WORDS)
    assert [(g.terms[0], g.soft) for g in got] == [("优化", True), ("设计", False), ("界面", False)]
    assert [g.terms[0] for g in search.concepts_of("designers memory the zebra", WORDS)] == ["设计", "记忆", "zebra"]
    odd = search.concepts_of("量子智能体", WORDS)
    assert [(g.terms[0], g.phrase) for g in odd] == [("量子", "量子"), ("智能体", "")]
    assert [g.terms[0] for g in search.concepts_of("三体问题", WORDS)] == ["三体", "体问", "问题"]
    assert search.concepts_of("ai", WORDS) == []


def test_concepts_rank_repositories(spark):
    rows = [(1, "ui designer", "design of ui by agents", 10, ["ui", "quantum-x"]), (2, "thing", "designed for agents", 90, ["ai"]), (3, "memory", "long memory", 5, ["memory"]), (4, "other", "量子界面", 1, ["quantum-x"])]
    frame = spark.createDataFrame(rows, "id int, name string, description string, stars int, topics array<string>")
    fields = {"name": 5, "description": 2}
    found = lambda q: {r.id for r in search.concept_ranked(frame, search.concepts_of(q, WORDS), fields).collect()}
    assert found("设计") == {1} and found("离线翻译") == set() and found("ai") == set() and found("memory 优化") == {3}
    groups = search.concepts_of("量子界面记忆", WORDS)
    noted = {"name": 5, "description": 3}
    assert search.wide_keywords(search.concepts_of("离线翻译", WORDS), WORDS) == ["translation"] or search.wide_keywords(search.concepts_of("离线翻译", WORDS), WORDS) == ["local", "translation"]
    assert search.wide_keywords(groups, WORDS, frame, noted) == ["ui", "memory", "quantum", "x"]
    assert search.wide_query(["ui", "design"], "2026-09-29") == "ui design ai in:name,description,topics stars:>100 pushed:>2026-04-02"
    assert search.wide_query(["agent"], "2026-09-29").startswith("agent in:") and search.wide_query([], "2026-09-29") is None
    assert [r.id for r in search.reranked(frame, search.concepts_of("设计 优化", WORDS), fields).collect()] == [1]
    near = [r.id for r in search.fuzzy_found(frame.withColumnRenamed("name", "title").withColumnRenamed("description", "summary"), "memry desig").collect()]
    assert set(near) >= {1, 3}


def test_boards(spark):
    rows = spark.createDataFrame([("a", 100, 140, 300), ("b", 10, 280, None), ("c", 9, 139, 5), ("d", None, 700, 1), ("e", 5, None, None), ("f", 0, None, 0)], "k string, daily int, weekly int, monthly int")
    got = {r.k: (r.momentum, r.g and tuple(r.g)) for r in boards.with_momentum(rows).withColumn("g", boards.gain_of("daily")).collect()}
    assert got == {"a": ("up", ("daily", 100)), "b": ("down", ("daily", 10)), "c": (None, ("daily", 9)), "d": (None, ("weekly", 700)), "e": (None, ("daily", 5)), "f": (None, ("daily", 0))}
    some = rows.withColumn("sources", F.array(F.lit("trending")))
    assert {r.k for r in boards.breakouts(some).collect()} == {"a", "e", "f"}
    kept = rows.withColumns({"sources": F.array(F.lit("paper")), "stars": F.lit(60)})
    assert {r.k for r in boards.worth_keeping(kept).collect()} == {"a", "b", "c", "d", "e"}
    drift = spark.range(30).select(F.when(F.col("id") < 20, 0).otherwise(3).alias("stars"))
    assert boards.markup_drift(drift).first().drifted and not boards.markup_drift(drift.limit(10)).first().drifted


def test_reports(spark):
    frame = spark.createDataFrame([(1, "a", None, "2024-01-02T10", "2024-01-02T11", "x", 5, None), (2, "b", "s", "2024-01-02T09", "2024-01-02T12", "y", 9, True), (3, "c", None, "2024-01-02T12", "2024-01-02T13", "x", 7, False)], "id int, title string, summary string, published_at string, first_seen string, category string, heat int, ai_selected boolean")
    one = daily.daily_report(frame, "2024-01-02", ["x", "y", "z"]).first()
    assert (one.n, one.featured, [list(s["items"]) for s in one.sections], one.flashes) == (3, [2, 1], [[3, 1], [2], []], [3, 1, 2])
    assert [(r.day, r.n, r.lead) for r in daily.daily_index(frame, "2024-01-05").collect()] == [("2024-01-02", 3, "b")]
    empty = daily.daily_report(frame.where("false"), "2024-01-02", ["x"]).first()
    assert empty.n == 0 and list(empty.featured) == []
    report = daily.crawl_report(spark.createDataFrame([("a", 3)], "source string, n long"), spark.createDataFrame([("validator", "v"), ("b", "e" * 300)], "source string, error string")).first()
    assert report.sources == {"a": 3} and len(report.errors["b"]) == 200 and report.dead == 1 and not report.failed


def test_categories(spark):
    rows = [("GPT-5 released", "x", None, "tip"), ("gpt-5 in passing", "x", None, "tip"), ("any", "arXiv cs.CL", None, None), ("New SDK launched", "x", None, None), ("a repo", "x", "github", None), ("融资", "x", None, None), ("How to", "x", None, None), ("通义千问发布", "x", None, None), ("nothing", "x", None, None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, title string, source string, origin string, category string").withColumn("summary", F.lit(None).cast("string"))
    got = {r.id: r.category for r in taxonomy.with_category(frame).collect()}
    assert [got[i] for i in range(len(rows))] == ["ai-models", "tip", "paper", "ai-products", "ai-products", "industry", "tip", "industry", "industry"]
    assert column(spark, ["dall·e and an agentic chip", "wagent"], taxonomy.topics_of) == [["openai", "agent", "chip"], []]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)]])
def test_empty_and_null_rows(spark, rows):
    frame = spark.createDataFrame(rows, REPO)
    assert repo_kinds.with_track(frame).count() == len(rows)


PAGE = """<html><article class="Box-row"><h2 class="h3"><a data-x="1" href="/acme/big.tool">acme / big.tool</a></h2><p class="col-9 color">Builds &amp; <b>ships</b>
 agents</p><span itemprop="programmingLanguage">Rust</span><span class="repo-language-color" style="background-color: #dea584"></span>
<a href="/acme/bigxtool/stargazers"><svg></svg> 9</a><a href="/acme/big.tool/stargazers"><svg a="b"></svg> 41,203</a><a href="/acme/big.tool/forks"><svg></svg>5,555</a>
<img class="avatar mb" src="https://a/1?s=40&amp;v=4" width="20" alt="@ann"/><img class="avatar" src="https://a/2" alt="@bob"/> 15,537 stars this week</article>
<article class="Box-row"><h2><a href="/x/bare">bare</a></h2> 1 star today</article><article class="Box-row"><p>no name</p></article></html>"""


def test_trending_pages(spark):
    from tidewire.operators import repos

    got = {r.full_name: r for r in repos.trending_rows(spark.createDataFrame([(PAGE,), ("",), (None,)], "html string")).collect()}
    a, b = got["acme/big.tool"], got["x/bare"]
    assert len(got) == 2 and (a.description, a.language, a.language_color, a.stars, a.forks, a.gained) == ("Builds & ships agents", "Rust", "#dea584", 41203, 5555, 15537)
    assert [(m.login, m.avatar) for m in a.built_by] == [("ann", "https://a/1?s=40&v=4"), ("bob", "https://a/2")]
    assert (b.description, b.language, b.stars, b.forks, b.gained, b.built_by) == (None, None, 0, 0, 1, [])


def test_snapshots_are_written_and_read(spark, tmp_path):
    from tidewire.sources import exports, snapshots

    d, kind = str(tmp_path), "id string, source string, fetched_at string"
    for name, body in (("array", '[{"id": "1", "source": "a"}, {"id": "2", "source": "b"}]'), ("object", '{"items": [{"id": "3", "source": "a"}]}'), ("bad", "oops")):
        (tmp_path / f"{name}.json").write_text(body)
    read = lambda n: sorted(r.id for r in snapshots.read_items(spark, f"{d}/{n}.json", kind).collect())
    assert read("array") == ["1", "2"] and read("object") == ["3"] and read("bad") == [] and read("missing") == []
    rows = spark.createDataFrame([("1", "a", None), ("2", "b", "then"), ("3", "a", None)], kind)
    snapshots.write_snapshot(rows, f"{d}/s", "now", spark.createDataFrame([("b", "HTTP 429")], "source string, error string"))
    items, meta = snapshots.read_snapshot(spark, f"{d}/s")
    assert sorted(r.fetched_at for r in items.collect()) == ["now", "now", "then"]
    meta = meta.first()
    assert (meta.fetched_at, meta["count"], meta.sources, meta.errors) == ("now", 3, {"a": 2, "b": 1}, {"b": "HTTP 429"})
    derived = snapshots.read_meta(spark, f"{d}/none", rows).first()
    assert derived["count"] == 3 and derived.fetched_at is None and snapshots.read_meta(spark, f"{d}/none", rows.where("false")).count() == 0
    assert snapshots.read_archive(spark, f"{d}/none", kind).count() == 0
    full = rows.withColumns({"heat": F.lit(3), "category": F.lit("tip"), "published_at": F.lit("2024-01-02T00"), "first_seen": F.lit(None).cast("string")})
    exports.write_endpoints(full, f"{d}/api", repos=rows)
    assert spark.read.json(f"{d}/api/sources").count() == 2 and spark.read.json(f"{d}/api/days").first()["id"] and spark.read.json(f"{d}/api/repos").count() == 3
    assert [r.n for r in spark.read.json(f"{d}/api/index").collect()] == [3]


def test_small_functions(spark):
    assert column(spark, ["Fast 🚀 tool ⚡️ here", "plain"], T.without_emoji) == ["Fast tool here", "plain"]
    assert column(spark, ["An AI and ai.", None], lambda c: T.highlighted(c, "ai")) == ["An <mark>AI</mark> and <mark>ai</mark>.", None]
    assert column(spark, [[1, 2, 3], [1]], lambda c: T.last_of(c, 2), "array<int>") == [[2, 3], [1]]
    assert column(spark, ["HTTPS://A.Example/x?y", "not a url", None], T.host) == ["a.example", None, None]
    slots = column(spark, ["", "机器之心", "a😀"], T.hash_slot)
    h = 0
    for unit in (0x673A, 0x5668, 0x4E4B, 0x5FC3):
        h = (h * 31 + unit + 2**31) % 2**32 - 2**31
    assert slots[:2] == [0, abs(h) % 10]
    from tidewire.functions import times

    now = "2026-07-27T00:30:00"
    seen = column(spark, ["2026-07-27T00:29:30", "2026-07-27T00:10:00", "2026-07-26T16:30:00", "2026-07-26T15:30:00", "2026-07-01T01:02:03", "junk", None], lambda c: times.relative(c, F.lit(now)))
    assert seen == ["刚刚", "20 分钟前", "8 小时前", "昨天", "7/1 09:02", "", ""]
    assert column(spark, ["2026-07-27T00:10:00", "2026-07-25T00:00:00", "junk"], lambda c: times.window(c, F.lit(now))) == ["今天（2026-07-27）", "2026-07-25 ~ 2026-07-27", ""]
    assert column(spark, ["2026-07-01", "2026-01-01", None], lambda c: times.is_young(c, F.lit(now))) == [True, False, False]
    assert column(spark, ["Mon, 01 Jan 2024 10:00:00 +0200", "2024-01-01", "junk", None], feeds.iso_time) == ["2024-01-01T08:00:00.000Z", "2024-01-01T00:00:00.000Z", None, None]
