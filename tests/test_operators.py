from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import classify, dedupe, feed, heat, search, state, stories, trends
from tidewire.sources import archive, feeds

ITEM = "id long, title string, summary string, source string, category string, published_at string, engagement long, origin string, ai_selected boolean, source_url string, heat long"


def item(i, title="t", summary=None, source="s", category="news", at="2026-07-26T12:00:00", engagement=None, origin=None, selected=None, url=None, heat=None):
    return (i, title, summary, source, category, at, engagement, origin, selected, url, heat)


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_text_functions(spark):
    v = lambda c: value(spark, c)
    assert v(T.clean_html(F.lit("<p>a&nbsp;&lt;b&gt;</p><script>x<y</script><style>p{}</style>\n c　d"))) == "a <b> c d"
    assert v(T.truncated(F.lit("hello world"), 6)) == "hello…" and v(T.truncated(F.lit("hi"), 6)) == "hi"
    assert v(T.url_key(F.lit("HTTPS://A.example/X//?q=1#z"))) == "a.example/x"
    assert v(T.title_key(F.lit("OpenAI: “GPT-6”, now!"))) == "openaigpt6now"
    assert v(T.story_tokens(F.lit("The OpenAI gpt-6. 大模型 and x"))) == ["openai", "gpt-6", "大模", "模型"]
    assert v(F.lit("国产gpu算力").rlike(T.word_edges("\\bgpu\\b"))) and not v(F.lit("said").rlike(T.word_edges("\\bai\\b")))
    assert [v(T.compact_number(F.lit(n))) for n in (999, 1234, 38123, 250_400)] == ["999", "1,234", "38.1k", "250k"]
    assert v(T.escaped(F.lit('a<b>&"'))) == "a&lt;b&gt;&amp;&quot;"
    assert v(T.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)))) == 0.5


def test_feed_filters_and_pages(spark):
    rows = [item(1, selected=True, category="a", heat=5), item(2, selected=None, heat=9, source="x"), item(3, selected=False, heat=None, title="OpenAI news"), item(4, at=None, heat=7)]
    df = spark.createDataFrame(rows, ITEM)
    ids = lambda d: sorted(r.id for r in d.collect())
    q = feed.FeedQuery
    assert ids(feed.filtered(df, q())) == [1, 2, 4] and ids(feed.filtered(df, q(mode="all"))) == [1, 2, 3, 4]
    assert ids(feed.filtered(df, q(mode="all", keyword=" openai "))) == [3] and ids(feed.filtered(df, q(mode="all", sources=["x", " "]))) == [2]
    assert ids(feed.filtered(df, q(mode="all", since="24h", now="2026-07-27T11:00:00"))) == [1, 2, 3]
    assert ids(feed.filtered(df, q(mode="all", since="1d", now="2026-07-28T11:00:00"))) == []
    assert ids(feed.filtered(df, q(mode="all", since="whenever"))) == [1, 2, 3, 4]
    got = feed.page(df, feed.hottest_first(), 99, 3).collect()
    assert [r.id for r in got] == [3] and got[0].total == 4 and got[0].total_pages == 2 and got[0].page == 2
    assert feed.page(df.where("false"), feed.hottest_first(), 1, 3).count() == 0


def test_heat(spark):
    rows = [item(1, origin="one", engagement=10), item(2, origin="one", engagement=10), item(3, origin="one", engagement=500), item(4, origin="two"), item(5, origin="lone", engagement=3), item(6, origin="one", at=None)]
    got = {r.id: r.heat for r in heat.with_heat(spark.createDataFrame(rows, ITEM).drop("heat"), {"one": 1, "two": 2}, "2026-07-26T12:00:00").collect()}
    third = (0 + 2) / 2 / 3
    assert got[1] == got[2] == int(55 + (third - 0.5) * 30 + 0.5) and got[3] == int(55 + (5 / 6 - 0.5) * 30 + 0.5)
    assert got[4] == 40 and got[5] == 40 and got[6] < 55


def test_dedupe(spark):
    rows = [item(1, url="http://a.example/x/", title="Big model launch today"), item(2, url="https://A.example/x?utm=1", summary="s", title="big MODEL launch, today!"), item(3, url="http://b.example", title="short"), item(4, url="http://c.example", title="Short")]
    df = spark.createDataFrame(rows, ITEM)
    assert {(r.id, r.place) for r in dedupe.by_url(df).collect()} == {(2, 1), (3, 3), (4, 4)}
    assert {(r.id, r.place) for r in dedupe.by_title(df).collect()} == {(2, 1), (3, 3), (4, 4)}


def test_relevance_and_classes(spark):
    ok = lambda t: value(spark, classify.relevant(F.lit(t)))
    assert all(map(ok, ["OpenAI ships", "AI adoption rises", "新的大模型", "GPU inference is cheap"]))
    assert not any(map(ok, ["first aid kit", "she said it with paint", "a gpu", "plain news"]))
    assert len(classify.STRONG_TERMS) == 109 and len(classify.WEAK_TERMS) == 17
    c = F.lit("b")
    assert value(spark, classify.first_match([("x", c == "a"), ("y", c == "b"), ("z", c == "b")], "n")) == "y"
    good = classify.sanitised(spark.createDataFrame([item(1, title="  a ", url="https://x"), item(2, title=" ", url="https://x"), item(3, url="ftp://x"), item(4, url="http://x", at="never", engagement=-5)], ITEM)).collect()
    assert [(r.id, r.title) for r in good] == [(1, "a"), (4, "t")] and good[1].published_at is None and good[1].engagement is None


def test_stories(spark):
    rows = [
        item(1, "OpenAI launches gpt-6 reasoning model", source="A", at="2026-07-20T10:00:00", heat=3),
        item(2, "OpenAI gpt-6 reasoning model is here", source="B", at="2026-07-21T10:00:00", heat=9),
        item(3, "gpt-6 reasoning model tested", source="C", at="2026-07-22T10:00:00", heat=1),
        item(4, "Unrelated quantum chips", source="C", at="2026-07-22T10:00:00"),
        item(5, "OpenAI launches gpt-6 reasoning model", source="D", at="2026-06-20T10:00:00"),
    ]
    got = stories.stories(spark.createDataFrame(rows, ITEM), "2026-07-22T12:00:00").collect()
    assert len(got) == 1 and got[0].story == 1 and got[0].n_items == 3 and got[0].n_sources == 3 and got[0].status == "developing" and got[0].title == rows[1][1]
    assert stories.stories(spark.createDataFrame(rows[:1], ITEM), "2026-07-22T12:00:00").count() == 0


def test_trends(spark):
    days = spark.createDataFrame([("a", "2026-01-01"), ("a", "2026-01-02"), ("a", "2026-01-04"), ("a", "2026-01-05"), ("a", "2026-01-06"), ("b", "2026-01-01")], "k string, d string").select("k", F.to_date("d").alias("day"))
    assert {r.k: r.streak for r in trends.streaks(days, "k").collect()} == {"a": 3, "b": 1}
    rows = spark.createDataFrame([(i, f"s{i % 2}", 100 - i) for i in range(20)], "id long, source string, heat long")
    assert [r.id for r in trends.capped_top(rows, 4, 10, [F.desc("heat"), F.col("id")]).orderBy("rank").collect()] == list(range(8))
    kinds = spark.createDataFrame([(1, "x", 9), (2, "x", 8), (3, "y", 1)], "id long, kind string, heat long")
    assert [r.id for r in trends.first_of_kind(kinds, "kind", [F.desc("heat")]).orderBy("place").collect()] == [1, 3, 2]


def test_state(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id long, source string, heat long")
    b = spark.createDataFrame([(2, "y", 5), (3, "z", 5)], "id long, source string, heat long")
    got = lambda d: sorted((r.id, r.heat) for r in d.collect())
    assert got(archive.upserted(a, b)) == [(1, 1), (2, 5), (3, 5)] and got(state.carried_over(b, a, ["x"])) == [(1, 1), (2, 5), (3, 5)] and got(state.carried_over(b, a, [])) == [(2, 5), (3, 5)]
    talk = spark.createDataFrame([(1, "user", "a"), (1, "assistant", "b"), (2, "robot", "c"), (3, "user", None)] + [(4, "user", "x")] * 9, "conv_id long, role string, text string")
    assert [r.conv_id for r in state.sanitised_conversations(talk).collect()] == [1]


def test_archive_is_upserted_by_month(spark, tmp_path):
    path = str(tmp_path / "archive")
    schema = "id long, published_at string, first_seen string, heat long"
    archive.write_archive(spark, spark.createDataFrame([(1, "2026-01-05", None, 1), (2, "2026-02-05", "", 1), (9, None, None, 1)], schema), path)
    archive.write_archive(spark, spark.createDataFrame([(2, "2026-02-05", None, 7), (3, "2026-02-09", None, 7)], schema), path)
    rows = spark.read.parquet(path)
    assert sorted((r.id, r.heat, r.month) for r in rows.collect()) == [(1, 1, "2026-01"), (2, 7, "2026-02"), (3, 7, "2026-02")]
    assert archive.kept_months(rows, "2026-04-10").count() == 2


def test_feeds(spark):
    body = "<rss><channel><item><title>One thing happened - The Site</title><link>http://a.example/1</link><description>&lt;p&gt;x&lt;/p&gt;</description></item><item><title>No link</title></item></channel></rss>"
    got = feeds.rss_items(spark.createDataFrame([("s", body), ("t", "not a feed")], "source string, body string"), strip_source=True).collect()
    assert [(r.source, r.title, r.source_url, r.summary) for r in got] == [("s", "One thing happened", "http://a.example/1", "x")]


def test_search(spark):
    rows = spark.createDataFrame([(1, "pdf parser", "tool", 80), (2, "table reader", "pdf", 0), (3, "other", "none", 0)], "id long, name string, topics string, heat long")
    got = {r.id: r.score for r in search.concept_ranked(rows, [["pdf"]], {"name": 5, "topics": 3}).collect()}
    assert got.keys() == {1, 2} and got[1] > got[2]
    assert search.concept_ranked(rows, [["pdf"], ["missing"]], {"name": 5}).count() == 0
    assert [r.id for r in search.reranked(rows, [["pdf"], ["tool"]], {"name": 5, "topics": 3}).collect()] == [1]


def test_near_copies_collapse_as_in_order(spark):
    import random
    import re
    from datetime import datetime, timezone

    rng = random.Random(4)
    vocab = ["openai", "gpt-5", "launch", "model", "apple", "iphone", "发布", "正式上线", "大模型", "new", "chip", "x1"]
    rows = []
    for i in range(120):
        words = rng.sample(vocab, rng.randrange(2, 8)) if i < 20 or rng.random() < 0.3 else (lambda w: rng.sample(w, len(w) - (rng.random() < 0.4)))(rows[rng.randrange(len(rows))][1].split(" "))
        at = rng.choice([None, *(f"2026-07-{d:02}T12:00:00" for d in (1, 3, 5, 20))])
        rows.append(item(i, " ".join(words), rng.choice([None, "", "s"]), at=at, engagement=rng.choice([None, 5]), selected=rng.choice([None, True]), heat=rng.choice([None, 9])))

    def tokens(t):
        out = set(re.findall("[a-z0-9][a-z0-9.-]{2,}", t.lower()))
        for run in re.findall("[\u2e80-\u9fff]+", t.lower()):
            out |= {run} if len(run) == 1 else {run[k : k + 2] for k in range(len(run) - 1)}
        return out

    def like(x, y):
        latin = [{t for t in z if re.match("[a-z0-9]", t)} for z in (x, y)]
        agree = len(latin[0] & latin[1]) / min(map(len, latin)) >= 0.5 if all(latin) else not any(latin)
        return min(len(x), len(y)) >= 4 and len(x & y) / len(x | y) >= 0.65 and agree

    kept, gone = [], set()
    for r in rows:
        time = datetime.fromisoformat(r[5]).replace(tzinfo=timezone.utc).timestamp() if r[5] else 0
        score = (2 if r[2] else 0) + (0.5 if r[8] else 0) + next((v for v in (r[6], r[10]) if v is not None), 0) * 1e-6
        for k in kept:
            if (time and k[2] and abs(time - k[2]) > 72 * 3600) or not like(tokens(r[1]), k[1]):
                continue
            gone.add(k[0] if score > k[3] else r[0])
            if score > k[3]:
                k[:] = [r[0], tokens(r[1]), time, score]
            break
        else:
            kept.append([r[0], tokens(r[1]), time, score])
    got = dedupe.collapse_near_dups(spark.createDataFrame(rows, ITEM).repartition(3))
    assert len(gone) > 10 and sorted(r.id for r in got.collect()) == [i for i in range(120) if i not in gone]
    assert dedupe.collapse_near_dups(spark.createDataFrame([], ITEM)).count() == 0
