"""Main text of web pages by differencing pages with their nearest URL.

A page is read into blocks of text.  Pages of a host are ordered by path, and each is paired with the neighbour that
shares more of its path; the longest common subsequence of their blocks is what the site repeats, and goes, inside
article and main elements too.  Of what is left, the blocks in such elements are the text if they hold at least half of its
characters; else all are, as the element is a teaser.  Menus, headers, footers, sidebars, notices, adverts, forms and reader
comments that markup names as such are left out on every page: elements always, classes where the name is of the whole part or the part
is small, and none where nothing would be left.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.llm.components import connected

# Names of HTML elements and of what sites call their parts.
RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "svg", "object", "audio", "video", "canvas", "math"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
ASIDE = {"nav", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "datalist"}
FRAME_PARTS = {"header", "footer"}
MAIN = {"article", "main"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "li", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "caption", "thead", "tbody", "blockquote", "pre", "figure", "figcaption", "form", "fieldset", "address", "hr", "body", "html", "head", "details", "summary", "dialog", "menu"}
PLAIN_PARTS = {"p", "li", "dt", "dd", "tr", "td", "th", "b", "i", "em", "strong", "a", "span", "u", "small", "font", "code", "sup", "sub", "q", "cite", "mark", "abbr", "time", "label", "html", "body"}
_WORDS = r"ads?|advert(?:s|isement|ising)?|adsense|banner|sponsor(?:s|ed)?|promo(?:tion)?s?|cookies?|consent|gdpr|sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|comments?|disqus|replies|share|sharing|social|related|recommended|popup|modal|newsletter|subscribe|signup|paywall|widget|toolbar|pagination|pager|skip-link"
_FRAME = r"notices?|alert|footer|header|masthead|comment-list"
_BOXES = r"(?:[_-](?:lists?|links?|buttons?|bar|box|section|widget|posts?|articles?|items?|stories|thread|form|area|container|wrapper|block|icons?|notice|banner|slot|unit|\d+))*"
#: A class or id that has such a word in it: it may name the part, or be a word of something else, such as "header-image" or "alert-levels".
NAMED = re.compile(rf"(?:^|[\s_-])(?:{_WORDS}|{_FRAME})(?:$|[\s_-]|\d)", re.I)
#: A class or id that is such a word, or a list or box of such, of the site or of a side of the page.
OUTER = re.compile(rf"(?:^|\s)(?:(?:site|page|global|top|bottom|left|right|primary|secondary|mobile|desktop)[_-])*(?:{_WORDS}|{_FRAME}){_BOXES}(?:$|\s)", re.I)
#: Inside an article or main element: "post-header" and "social-policy" are text.
INNER = re.compile(rf"(?:^|\s)(?:{_WORDS}){_BOXES}(?:$|\s)", re.I)
#: A part whose name only has a word in it is left out if it has at most this share of the page's characters.
SMALL = 0.25
#: Pages that share this part of the longer one's characters are copies, and no evidence of what the site repeats.
NEAR = 0.8
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)")
MARKS = re.compile("[\"'>]")
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")


class _Closings:
    """Where tags close: the first > after a place that no quotes hold.

    All places together cost no more than one pass over the page, however many of its tags are never closed.
    """

    def __init__(self, page: str) -> None:
        marks = [(m.start(), m[0]) for m in MARKS.finditer(page)]
        self.places = [at for at, _ in marks]
        after: dict[str, int] = {}
        self.ends = [-1] * (len(marks) + 1)  # by mark, if it is met outside of quotes
        for k in range(len(marks) - 1, -1, -1):
            at, mark = marks[k]
            if mark == ">":
                self.ends[k] = at
            elif mark in after:
                self.ends[k] = self.ends[after[mark] + 1]
            after[mark] = k

    def after(self, at: int) -> int:
        """The place of that >, or -1."""
        return self.ends[bisect_left(self.places, at)]


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of tags, comments and declarations in order, the latter two without a name.

    Inside a raw element only its end tag counts, which is one more tag; without it the rest of the page is the element's.  A < that
    begins no tag is text.
    """
    at, closings, end = page.find("<"), None, len(page)
    while at >= 0:
        if page.startswith("<!--", at):
            to = page.find("-->", at + 4)
            to = end if to < 0 else to + 3
            yield at, to, False, "", ""
        elif page.startswith(("<!", "<?"), at):
            to = page.find(">", at) + 1
            if not to:
                return  # nor does any later tag close
            yield at, to, False, "", ""
        else:
            m = TAG.match(page, at) if closings is None else None
            if m:
                closing, name, attributes, to = m[1], m[2], m[3], m.end()
            elif name_of := TAG_NAME.match(page, at):
                closings = closings or _Closings(page)
                to = closings.after(name_of.end()) + 1
                closing, name, attributes = name_of[1], name_of[2], page[name_of.end() : to - 1] if to else ""
            else:
                to = 0
            if not to:
                at = page.find("<", at + 1)
                continue
            name = name.lower()
            yield at, to, bool(closing), name, attributes
            if name in RAW and not closing and not attributes.rstrip().endswith("/"):
                last = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(page, to)
                yield (last.start(), last.end(), True, name, "") if last else (end, end, True, name, "")
                to = last.end() if last else end
        at = page.find("<", to)


def blocks(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, in an article or main element, in a part to leave out) of each block with text, in page order.

    Elements and roles decide first.  A whole class or id decides for its part, and one that only has a word of the list in it if the part is small.
    Where nothing would be left, names decide nothing.
    """
    page = page or ""
    out: list[tuple[str, bool, int]] = []
    parts: list[tuple[bool, int]] = [(False, 0)]  # of names: whether the whole name says it, and the part around it
    open_: list[tuple[str, bool, int]] = []  # element, main, and the part: 0 none, -1 left out by its kind
    state, words, at, raw = (False, 0), [], 0, ""

    def end() -> None:
        if text := SPACE.sub(" ", entities.unescape("".join(words))).strip():
            out.append((text, *state))
        words.clear()

    for start, stop, closing, name, attributes in tags(page):
        if raw:
            raw, at = "", stop
            continue
        words.append(page[at:start])
        at = stop
        if not name:
            continue
        if name in BLOCKS:
            end()
        elif name in ("br", "td", "th", "option", "img"):
            words.append(" ")
        if closing:
            if any(n == name for n, _, _ in open_):
                end()
                while open_.pop()[0] != name:
                    pass
                state = (open_[-1][1], open_[-1][2]) if open_ else (False, 0)
        elif name in RAW:
            if not attributes.rstrip().endswith("/"):
                raw = name
        elif name not in VOID and not (attributes.endswith("/") and name not in BLOCKS):
            main, part = state[0] or name in MAIN, state[1]
            if part >= 0 and (name in ASIDE or (name in FRAME_PARTS and not state[0])):
                part = -1
            if part >= 0 and name not in MAIN and name not in ("html", "body") and attributes:
                whole = some = False
                for a in NAMES.finditer(attributes):
                    value = a[2] or a[3] or a[4] or ""
                    if a[1].lower() == "role":
                        part = -1 if value.strip().lower() in ROLES else part
                    else:
                        whole |= bool((INNER if main else OUTER).search(value))
                        some |= not main and bool(NAMED.search(value))
                if part >= 0 and (whole or some):
                    parts.append((whole, part))
                    part = len(parts) - 1
            if name not in PLAIN_PARTS or part != state[1]:
                end()
                open_.append((name, main, part))
                state = (main, part)
    if not raw:
        words.append(page[at:])
    end()
    return _decided(out, parts)


def _decided(found: list[tuple[str, bool, int]], parts: list[tuple[bool, int]]) -> list[tuple[str, bool, bool]]:
    """Blocks with the decisions about named parts; a part comes after the part around it."""
    sure = [False] * len(parts)  # in a part that its whole name decides for
    for k in range(1, len(parts)):
        sure[k] = parts[k][0] or sure[parts[k][1]]
    sizes = [0] * len(parts)
    for text, _, part in found:
        if part >= 0 and not sure[part]:
            sizes[part] += len(text)
    for k in range(len(parts) - 1, 0, -1):
        sizes[parts[k][1]] += sizes[k]
    gone = [False] * len(parts)
    for k in range(1, len(parts)):
        gone[k] = sure[k] or sizes[k] <= SMALL * sizes[0] or gone[parts[k][1]]
    if not any(part >= 0 and not gone[part] for _, _, part in found):
        gone = [False] * len(parts)
    return [(text, main, part < 0 or gone[part]) for text, main, part in found]


def own_blocks(page: str | None) -> list[tuple[str, bool]]:
    """(text, in an article or main element) of the blocks that markup doesn't leave out."""
    return [(t, main) for t, main, aside in blocks(page) if not aside]


def common(a: list[int], b: list[int]) -> list[int]:
    """Indices of a that a longest common subsequence with b takes, by rows of bits."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    inner: list[int] = []
    if x and y:
        places: dict[int, int] = {}
        for j, v in enumerate(y):
            places[v] = places.get(v, 0) | 1 << j
        full = (1 << len(y)) - 1
        rows, row = [], full  # a zero bit j of row i: the subsequence of x[:i] and y[:j + 1] is longer than that of y[:j]
        for v in x:
            use = row & places.get(v, 0)
            row = ((row + use) | (row - use)) & full
            rows.append(row)
        j = len(y)
        for i in range(len(x) - 1, -1, -1):
            before = rows[i - 1] if i else full
            while j and rows[i] >> (j - 1) & 1:
                j -= 1
            if not j:
                break
            if before >> (j - 1) & 1:  # the step at j came with x[i]
                inner.append(head + i)
                j -= 1
    return [*range(head), *reversed(inner), *range(len(a) - tail, len(a))]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in K.slices(batches, "html"):
        found = [[t for t, _ in own_blocks(h)] for h in part.column("html").to_pylist()]
        rows, sizes = [[_hash(t) for t in x] for x in found], [[len(t) for t in x] for x in found]
        content = [hashlib.blake2b(np.array(x, "<i8").tobytes(), digest_size=16).digest() for x in rows]
        columns = [*(part.column(c) for c in ("key", "host", "path")), pa.array(content, pa.binary()), pa.array(rows, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "host", "path", "content", "lines", "sizes"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, close = [], []
        for a, x, b, y in zip(*(batch.column(c).to_pylist() for c in ("lines", "sizes", "other_lines", "other_sizes"))):
            shared.append(common(a, b))
            close.append(sum(x[k] for k in shared[-1]) >= NEAR * max(sum(x), sum(y), 1))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("other"), pa.array(shared, pa.list_(pa.int32())), pa.array(close, pa.bool_())], ["key", "other", "shared", "close"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in K.slices(batches, "html"):
        out = []
        for page, shared in zip(part.column("html").to_pylist(), part.column("shared").to_pylist()):
            gone = set(shared or ())
            left = [(t, main) for k, (t, main) in enumerate(own_blocks(page)) if k not in gone]
            inner = [t for t, main in left if main]
            most = inner and 2 * sum(map(len, inner)) >= sum(len(t) for t, _ in left)
            out.append("\n".join(inner if most else (t for t, _ in left)))
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def neighbours(keys: DataFrame) -> DataFrame:
    """(key, other, host, path, part) of rows (key, host, path): the page next to it by (path, key) within its host that shares more of the path.

    Ties go to the one before.  Pages are put in order over all hosts by ranges, so that a large host is many
    tasks; only the ends of ranges meet across tasks.  part is the range.
    """
    row = F.struct("host", "path", "key")
    order = keys.select("host", "path", "key").repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
    order = K.kept(order.withColumn("part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("part").orderBy("host", "path", "key")
    ends = order.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    across = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(across).alias("before_part"), F.lead("first").over(across).alias("after_part"))
    near = order.withColumn("before", F.lag(row).over(inside)).withColumn("after", F.lead(row).over(inside)).join(ends, "part")
    near = near.withColumn("before", F.coalesce("before", "before_part")).withColumn("after", F.coalesce("after", "after_part"))

    def shared(other: str) -> Column:
        letters = lambda c: F.split(c, "")
        differs = F.array_position(F.zip_with(letters("path"), letters(f"{other}.path"), lambda x, y: x.eqNullSafe(y)), F.lit(False))
        same = F.when(differs > 0, differs).otherwise(F.length("path") + 1)  # one more than the characters that both begin with
        return F.when(F.col(f"{other}.host") == F.col("host"), same).otherwise(-1)

    near = near.withColumn("b", F.coalesce(shared("before"), F.lit(-1))).withColumn("a", F.coalesce(shared("after"), F.lit(-1)))
    return near.where("a > 0 or b > 0").select("key", F.when(F.col("b") >= F.col("a"), F.col("before.key")).otherwise(F.col("after.key")).alias("other"), "host", "path", "part")


def _compare(near: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, other, shared, close) of pairs (key, other): the blocks of key that other repeats, and whether they are copies."""
    own = lines.select("key", "lines", "sizes")
    other = lines.select(F.col("key").alias("other"), F.col("lines").alias("other_lines"), F.col("sizes").alias("other_sizes"))
    pairs = near.select("key", "other").join(own, "key").join(other, "other")
    return K.kept(pairs.mapInArrow(_compared, "key string, other string, shared array<int>, close boolean"), "pairs")


def repeated(lines: DataFrame) -> DataFrame:
    """(key, shared) of pages (key, host, path, content, lines, sizes): the blocks that the nearest page that is no copy repeats.

    Pages of a host with equal blocks are one.  Nearest pages that are near copies are joined into one as well, which is
    paired anew, until none are left; each of them is then held against the page that theirs was paired with.  Where all pages of a
    host are copies of each other nothing tells the site's blocks from theirs, and none is shared.
    """
    heads = lines.groupBy("host", "content").agg(F.min(F.struct("path", "key")).alias("head"), F.count(F.lit(1)).alias("n"))
    heads = K.kept(heads.select("host", "content", "n", "head.path", "head.key"), "heads")
    copies = lines.select("key", "host", "content").join(heads.where("n > 1").select("host", "content", F.col("key").alias("head")), ["host", "content"]).where("key <> head").select("key", "head")
    active, final, merged = heads.select("key", "host", "path"), None, None
    while True:
        near = K.kept(neighbours(active), "near")
        pairs = _compare(near, lines)
        named = pairs.join(near.select("key", "host", "path", "part"), "key")
        # by range and host, so that a large host is many tasks
        hosts = near.select("part", "host").distinct().join(named.where("close").select("host").distinct(), "host", "left_semi")
        settled = named.join(hosts, ["part", "host"], "left_anti").select("key", "other", "shared")
        final = settled if final is None else final.unionByName(settled)
        links = pairs.where("close").select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()
        if links.isEmpty():
            break
        joined = K.kept(connected(links).where("node <> label").select(F.col("node").alias("key"), "label"), "joined")
        if merged is None:
            merged = joined
        else:
            over = joined.select(F.col("key").alias("label"), F.col("label").alias("over"))
            merged = K.kept(merged.join(over, "label", "left").select("key", F.coalesce("over", "label").alias("label")).unionByName(joined), "merged")
        active = K.kept(near.join(hosts, ["part", "host"], "left_semi").join(joined, "key", "left_anti").select("key", "host", "path"), "active")
    shared = final.select("key", "shared")
    if merged is not None:
        shared = shared.unionByName(_compare(merged.join(final.select(F.col("key").alias("label"), "other"), "label"), lines).select("key", "shared"))
    shared = K.kept(shared.where(F.size("shared") > 0), "shared")
    return shared.unionByName(copies.join(shared.withColumnRenamed("key", "head"), "head").select("key", "shared"))


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text and n_chars (code points).

    Null pages are empty, and an empty text is "".  Rows that repeat get equal texts, null ids and urls too; pages without a
    host are each other's neighbours.  Other columns are ignored.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.md5(F.concat_ws("\u0001", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce("url", F.lit("-")), "html")))
    keyed = rows.select("key", _host(F.col("url")).alias("host"), _path(F.col("url")).alias("path"), "html")
    lines = keyed.mapInArrow(_hashed, "key string, host string, path string, content binary, lines array<long>, sizes array<int>").dropDuplicates(["key"])
    shared = repeated(K.kept(lines, "lines"))
    kind = rows.schema["page_id"].dataType.simpleString()
    out = rows.join(shared, "key", "left").select("page_id", "url", "html", "shared").mapInArrow(_texts, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op4_nearest_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
