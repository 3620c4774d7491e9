import json

from tidewire.sources import feed_registry
from tidewire.sources import feed_source as S

RSS = '<?xml version="1.0" encoding="UTF-8"?>\n<rss><channel>{}</channel></rss>'
ITEM = "<item><title>{0}</title><link>https://x.example/{0}</link></item>"


def folder(tmp_path):
    put = lambda name, data: (tmp_path / f"{name}.xml").write_bytes(data if isinstance(data, bytes) else data.encode())
    put("good", RSS.format("".join(ITEM.format(f"G{k}") for k in range(25))))
    put("other", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Atom é</title><link href="https://x.example/a"/></entry></feed>')
    put("latin", '<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel>'.encode("latin-1") + ITEM.format("Ä").encode("latin-1") + b"</channel></rss>")
    put("broken", RSS.format(ITEM.format("x"))[:-20])
    put("page", "<html><body>Not found</body></html>")
    put("empty", "")
    put("bytes", b"\xff\xfe\x00garbage" * 100)
    put("none", RSS.format(""))
    put("big", RSS.format("<item>" + "x" * 5000 + "</item>"))
    names = ["good", "other", "latin", "broken", "page", "empty", "bytes", "none", "big", "missing"]
    return json.dumps([{"feed": f"rss:{n}", "source": n, "tier": 2} for n in names])


def test_good_broken_and_missing_documents(spark, tmp_path):
    registry = folder(tmp_path)
    docs = S.documents(spark, str(tmp_path), registry=registry, max_bytes="4000")
    assert docs.rdd.getNumPartitions() == 10
    items, report = S.crawled(docs)
    got = {r.feed: (r.n, r.error) for r in report.collect()}
    assert {f: n for f, (n, _) in got.items()} == {"rss:good": 20, "rss:other": 1, "rss:latin": 1, **{f"rss:{n}": 0 for n in ("broken", "page", "empty", "bytes", "none", "big", "missing")}}
    assert {f for f, (_, e) in got.items() if e} == {f"rss:{n}" for n in ("broken", "page", "empty", "bytes", "big", "missing")}
    assert got["rss:missing"][1] == "no document" and got["rss:page"][1] == "<html> isn't a feed" and all(len(e or "") <= 200 for _, e in got.values())
    assert {r.title for r in items.collect() if r.origin in ("rss:other", "rss:latin")} == {"Atom é", "Ä"}
    uri = {r.feed: r.error is None for r in S.documents(spark, tmp_path.as_uri(), registry=registry).collect()}
    assert uri["rss:good"] and uri["rss:latin"] and not uri["rss:missing"]


def test_filters_reach_the_source(spark, tmp_path):
    registry = folder(tmp_path)
    docs = S.documents(spark, str(tmp_path), registry=registry)
    feeds = lambda frame: (frame.rdd.getNumPartitions(), sorted(r.feed[4:] for r in frame.collect()))
    assert feeds(docs.where("feed like 'rss:b%'")) == (3, ["big", "broken", "bytes"])
    assert feeds(docs.where("feed = 'rss:good'")) == (1, ["good"])
    assert feeds(docs.where("feed in ('rss:good', 'rss:page') and error is null")) == (2, ["good"])
    assert feeds(docs.where("feed like 'rss:b%' and feed like 'rss:br%'"))[1] == ["broken"]
    assert feeds(docs.where("feed = 'rss:b' or source = 'page'"))[1] == ["page"]
    assert docs.where("feed like 'nothing%'").collect() == [] and docs.count() == 10
    assert feeds(S.documents(spark, str(tmp_path), ["rss:go", "rss:missing"], registry=registry)) == (2, ["good", "missing"])


def test_documents_in_parts_and_the_registry(spark, tmp_path):
    at = tmp_path / "feed=one"
    at.mkdir()
    (at / "part-0").write_text("<rss><channel>" + ITEM.format("a"))
    (at / "part-1").write_text(ITEM.format("b") + "</channel></rss>")
    (at / ".part-1.crc").write_text("no")
    items, _ = S.crawled(S.documents(spark, str(tmp_path), registry='[{"feed": "one", "source": "One"}]', pattern="feed={name}"))
    assert [r.title for r in items.orderBy("ord").collect()] == ["a", "b"]
    known = feed_registry.registry(spark).collect()
    assert len(known) == len({r.feed for r in known}) == 44 and {r.tier for r in known} == {1, 2, 3}
    assert sum(r.ai_only for r in known) == 10 and [r.feed for r in known if r.strip_source] == ["rss:anthropic", "rss:meta-ai"]
    assert S.documents(spark, str(tmp_path), ["rss:meta"]).collect()[0].error == "no document"
