import random

from tidewire.llm import html_text as H


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def subsequence(x, y):
    it = iter(y)
    return all(v in it for v in x)


def test_common_lines_are_a_longest_subsequence():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        got = H.common(a, b)
        assert len(got) == lcs(a, b) and got == sorted(set(got)) and subsequence([a[i] for i in got], b)


def test_blocks():
    page = """<!DOCTYPE html><head><title>no</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</li></ul></nav>
    <!-- <p>hidden</p> --><div class="ad">Buy</div><div id="cookie-notice">We use</div><article><header><h1>Head &amp; line</h1></header><p>One
      two<br>three <b>bold</b>face&nbsp;x<p>Next &#233;&lt;b&gt;<script>var a = "</p>";</script></p><aside>Side</aside><form><p>In</p></form>
      <section class="comments"><p>Reader</p></section><div class="padding">Kept</div></article><footer>&copy; x</footer>"""
    found = H.blocks(page)
    assert [t for t, main, aside in found if main and not aside] == ["Head & line", "One two three boldface x", "Next é<b>", "Kept"]
    assert {t for t, _, aside in found if aside} == {"Site", "Menu", "Buy", "We use", "Side", "In", "Reader", "© x"}
    assert H.blocks(None) == H.blocks("") == [] and H.blocks("plain  text <") == [("plain text <", False, False)]
    assert H.blocks("<p>a<script>never closed <p>b") == [("a", False, False)]


def kept(page):
    return [t for t, _, aside in H.blocks(page) if not aside]


def test_names_never_take_the_text():
    text = "A paragraph that is the text of this page, and long enough to be that."
    assert kept(f'<div class="content header-image"><h1>Head</h1><p>{text}</p></div>') == ["Head", text]
    assert kept(f'<div class="alert-levels"><p>{text}</p><div class="sidebar">Side</div></div>') == [text]
    assert kept(f'<div class="comments"><p>{text}</p></div>') == [text] and kept(f'<div id="header"><nav>m</nav><p>{text}</p></div>') == [text]
    assert kept(f'<div class="site-header">Site</div><div class="my-banner-box-x">Small</div><div class="page"><p>{text}</p></div><div class="page_footer_links">End</div>') == [text]
    assert kept(f'<div class="big-header-x"><p>{text}</p><div class="x-promo-y">Buy</div></div><p>{text}</p>') == [text, text]
    assert kept("<nav>m</nav><form>f</form>") == []


def test_tags_that_never_close():
    import time

    for bad in ("<a ", "<a \"", "<a '", "<a'\"", "<!", "<!-- ", "<aa", "<a b=\"<", "</", "<script ", "<p>x<a \""):
        page = f"<p>Text.</p>{bad * (1_000_000 // len(bad))}"
        began = time.time()
        assert H.blocks(page)[0][0] == "Text."
        assert time.time() - began < 4, bad
    assert kept("<p>a < b</p><p>5<6 <b>x</b>") == ["a < b", "5<6 x"]
    assert kept("<p title='a > b'>one</p><p title=\"it's > \">two</p><p title=\"never closed>three</p>") == ["one", "two", '<p title="never closed>three']
    assert kept("<script>if (a<b && c=='</p>') x()</script><p>after</p><SCRIPT>1</Script ><p>more") == ["after", "more"]


def test_nearest_path(spark):
    rng = random.Random(9)
    rows = [(f"{k:03}", rng.choice(["a", "b", ""]), "".join(rng.choice("/xyé") for _ in range(rng.randrange(0, 9)))) for k in range(120)] + [("long", "a", "/x" * 30_000), ("long2", "a", "/x" * 29_000 + "y")]
    got = {r.key: r.other for r in H.neighbours(spark.createDataFrame(rows, "key string, host string, path string").repartition(6)).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2].encode(), r[0]))
    want = {}
    for k, (key, host, path) in enumerate(order):
        best = None
        for j in (k - 1, k + 1):
            if 0 <= j < len(order) and order[j][1] == host:
                n = 0
                while n < min(len(path), len(order[j][2])) and path[n] == order[j][2][n]:
                    n += 1
                if best is None or n > best[0]:
                    best = (n, order[j][0])
        if best:
            want[key] = best[1]
    assert got == want


def made():
    pages = []
    for i in range(30):
        pages.append((i, f"http://a.example/news/{i // 10}/{i}", f"<div>Welcome to A</div><div>Today {i}</div><p>Own text {i}.</p><p>More {i}</p><div>Terms of A</div>"))
    pages.append((100, "http://solo.example/x", "<p>Only page</p>"))
    pages.append((101, "http://b.example/x", "<nav>m</nav><article><p>Copied</p></article>"))
    pages.append((102, "https://b.example/x?y=1", "<nav>m</nav><article><p>Copied</p></article>"))
    pages += [(103, None, None), (104, "", ""), (None, "http://c.example/q", "<p>x</p>"), (None, "http://c.example/q", "<p>x</p>")]
    return pages


def test_shared_lines_go(spark):
    frame = spark.createDataFrame([(*p, "k") for p in made()], "page_id long, url string, html string, key string")
    rows = H.main_text(frame.repartition(7)).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(made())
    for i in range(30):
        assert got[i] == f"Today {i}\nOwn text {i}.\nMore {i}"
    assert got[100] == "Only page" and got[101] == got[102] == "Copied" and got[103] == got[104] == ""
    assert all(r.n_chars == len(r.text) for r in rows)
    assert H.main_text(frame.where("false")).count() == 0


def texts(spark, pages):
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id long, url string, html string").repartition(5)
    return [r.text for r in sorted(H.main_text(frame).collect(), key=lambda r: r.page_id)]


def test_site_lines_inside_articles_go_and_named_blocks_of_the_text_stay(spark):
    page = lambda i: f"<article><div class='post-header'><h1>Title {i}</h1></div><p>Share this</p><div id='social-policy'>Policy of {i}</div><p>Text of number {i}, long enough.</p><div class='share-buttons'>Like</div></article>"
    got = texts(spark, [(f"http://a.example/{i}", page(i)) for i in range(6)])
    assert got == [f"Title {i}\nPolicy of {i}\nText of number {i}, long enough." for i in range(6)]
    teaser = lambda i: f"<article><p>Teaser {i}</p></article><div>The whole text of page {i} is outside of it.</div><div>Terms</div>"
    assert texts(spark, [(f"http://b.example/{i}", teaser(i)) for i in range(4)]) == [f"Teaser {i}\nThe whole text of page {i} is outside of it." for i in range(4)]


def test_copies_are_no_neighbours(spark):
    page = lambda i, date="": f"<div>Welcome</div><div>Long text of page number {i}, which only this one has.</div><p>More of {i}, and more again.</p><p>{date}</p><div>Terms</div>"
    own = lambda i: f"Long text of page number {i}, which only this one has.\nMore of {i}, and more again."
    pages = [("http://a.example/n/1", page(1)), ("https://a.example/n/1?x=1", page(1)), ("http://a.example/n/1/", page(1)), ("http://a.example/n/1/print", page(1, "p. 1")), ("http://a.example/n/2", page(2)), ("http://a.example/n/3", page(3))]
    pages += [("http://copies.example/1", page(7)), ("http://copies.example/1?print", page(7)), ("http://copies.example/1/print", page(7, "p. 1"))]
    got = texts(spark, pages)
    assert got[:6] == [own(1), own(1), own(1), own(1) + "\np. 1", own(2), own(3)]
    assert got[6:] == [f"Welcome\n{own(7)}\nTerms"] * 2 + [f"Welcome\n{own(7)}\np. 1\nTerms"]
