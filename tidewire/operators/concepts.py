"""Concepts of search, and many queries at once: segmentation of a column by a trie, and ranking of rows for each query."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.lineage import shared_folder
from tidewire.operators.search import CJK, GUARDED, SOFT_FACTOR, Dictionary, Group, group_weight

# Ways to say one thing, in both languages; words that only rank; and words without meaning here.
CONCEPTS = (
    ("设计", "design"),
    ("界面", "前端", "ui", "ux", "frontend", "interface", "gui"),
    ("智能体", "代理", "agent", "agentic"),
    ("多智能体", "multi-agent", "multi agent", "multiagent", "swarm"),
    ("编程", "代码", "写代码", "coding", "code", "programming", "developer"),
    ("记忆", "memory"),
    ("浏览器", "browser", "chrome", "playwright"),
    ("自动化", "automation", "automate", "automated"),
    ("语音", "声音", "配音", "voice", "speech", "tts", "audio"),
    ("克隆", "clon"),
    ("音乐", "歌", "music", "song"),
    ("视频", "video"),
    ("图像", "图片", "绘画", "画图", "image", "picture", "drawing", "diffusion"),
    ("游戏", "game", "gaming"),
    ("桌宠", "宠物", "陪伴", "pet", "companion"),
    ("知识库", "检索", "rag", "retrieval", "knowledge"),
    ("文档", "document", "docs", "pdf", "ocr"),
    ("办公", "表格", "幻灯片", "office", "spreadsheet", "slides", "excel"),
    ("数据库", "database", "sql"),
    ("搜索引擎", "search"),
    ("机器学习", "深度学习", "machine learning", "deep learning", "ml"),
    ("安全", "审计", "security", "audit", "pentest", "red team"),
    ("金融", "股票", "交易", "量化交易", "finance", "financial", "stock", "trading", "quant"),
    ("机器人", "具身", "robot", "embodied", "humanoid", "vla"),
    ("世界模型", "world model", "world-model"),
    ("论文", "学术", "研究", "paper", "research", "arxiv"),
    ("教程", "课程", "入门", "学习", "tutorial", "course", "beginner", "lesson"),
    ("推理", "inference", "serving"),
    ("训练", "微调", "training", "fine-tun", "finetun", "lora"),
    ("大模型", "模型", "model", "llm"),
    ("部署", "deploy", "self-hosted"),
    ("提示词", "提示", "prompt"),
    ("技能", "skill"),
    ("工作流", "workflow", "pipeline"),
    ("终端", "命令行", "terminal", "cli"),
    ("桌面", "desktop"),
    ("手机", "移动端", "移动", "mobile", "android", "ios"),
    ("本地", "离线", "local", "offline", "self-hosted", "on-device"),
    ("网关", "路由", "gateway", "router", "proxy"),
    ("评测", "基准", "benchmark", "eval"),
    ("图表", "架构图", "可视化", "diagram", "chart", "visualiz"),
    ("翻译", "translat"),
    ("写作", "小说", "writing", "novel", "story"),
    ("爬虫", "抓取", "scrap", "crawl"),
    ("测试", "test"),
    ("数据", "data"),
    ("插件", "plugin", "extension"),
    ("协作", "团队", "collaborat", "team"),
    ("电脑操控", "操控电脑", "computer-use", "computer use"),
    ("审美", "美感", "品味", "taste", "aesthetic"),
    ("数字人", "虚拟人", "avatar", "digital human", "talking head"),
    ("字幕", "转写", "转录", "subtitle", "transcri", "whisper", "caption"),
    ("会议", "meeting"),
    ("邮件", "邮箱", "email", "mail"),
    ("笔记", "note-taking", "notes", "obsidian"),
    ("知识图谱", "knowledge graph", "graphrag"),
    ("向量", "嵌入", "embedding", "vector"),
    ("上下文", "context"),
    ("沙箱", "隔离", "sandbox", "isolat"),
    ("虚拟机", "容器", "vm", "docker", "container", "kubernetes"),
    ("监控", "可观测", "追踪", "monitor", "observab", "tracing"),
    ("成本", "省钱", "cost", "token usage", "token saving"),
    ("免费", "free"),
    ("客服", "customer support", "helpdesk"),
    ("营销", "seo", "marketing"),
    ("电商", "e-commerce", "ecommerce", "shop"),
    ("医疗", "医学", "健康", "medical", "health", "clinical"),
    ("法律", "合规", "legal", "compliance", "law"),
    ("教育", "课堂", "education", "classroom", "teach"),
    ("科研", "科学", "science", "scientific"),
    ("多模态", "multimodal"),
    ("视觉", "vision", "visual"),
    ("三维", "3d", "mesh", "gaussian"),
    ("时间序列", "预测", "time series", "forecast"),
    ("强化学习", "reinforcement learning", "rl"),
    ("蒸馏", "量化", "压缩", "distill", "quantiz", "compress"),
    ("显卡", "gpu", "cuda"),
    ("苹果", "mac", "macos", "apple silicon", "mlx"),
    ("代码评审", "代码审查", "code review"),
    ("版本控制", "git", "worktree"),
    ("调试", "debug"),
    ("主题", "皮肤", "theme", "skin"),
    ("后端", "接口", "api", "backend", "sdk"),
    ("简历", "求职", "resume", "job"),
    ("社交", "推特", "social", "twitter"),
    ("新闻", "资讯", "news"),
    ("地图", "map"),
    ("框架", "framework"),
    ("运行时", "runtime"),
    ("编排", "orchestrat"),
    ("角色扮演", "女友", "roleplay", "role-play", "girlfriend"),
    ("截图", "screenshot"),
    ("支付", "payment", "pay"),
)
SOFT = (
    ("优化", "提升", "改进", "改善", "更好", "增强", "optimiz", "improv", "better", "enhanc"),
)
NOISE = (
    "ai", "人工智能", "github", "相关", "有关", "关于", "项目", "仓库", "工具", "开源", "帮我", "我想", "我希望", "希望", "想要", "查找", "寻找", "搜索", "一些", "哪些", "有没有", "可以", "能够",
    "用来", "用于", "方面", "类似", "什么", "的", "跟", "和", "与", "上", "找", "做", "能", "及", "或", "等", "是", "在", "跑", "用", "让", "把", "来", "运行", "使用", "repo",
    "repos", "project", "projects", "related", "about", "for", "the", "and", "with", "of", "to", "a", "an",
)
DICTIONARY = Dictionary([list(c) for c in CONCEPTS], [list(c) for c in SOFT], frozenset(NOISE))
#: Terms that one scan of the rows looks for.
TERMS_AT_ONCE = 50_000
#: Rows that are Python objects at once in a worker.
ROWS_AT_ONCE = 256
#: Shares of the rows in joins by a query or a concept, of which there may be few.
SHARES = 96
RUN = re.compile("[a-z0-9][a-z0-9.+#-]*|[一-鿿]+")
GROUP = "k int, terms array<string>, soft boolean, phrase string"


class Trie:
    """Terms by their letters; a gap is a place where a space or hyphen may stand or not."""

    def __init__(self, terms) -> None:
        self.root: dict = {}
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(" " if c == "-" else c, {})
            node.setdefault("", []).append(term)

    def longest(self, text: str, at: int) -> str | None:
        """The longest term that the text has here, letter by letter."""
        node, best = self.root, None
        while True:
            best = node[""][0] if "" in node else best
            if at == len(text) or text[at] not in node:
                return best
            node, at = node[text[at]], at + 1

    def starting(self, text: str, at: int):
        """(term, end) of all terms that begin here, with their gaps as the text has them."""
        open_ = [(self.root, at)]
        while open_:
            node, k = open_.pop()
            for term in node.get("", ()):
                yield term, k
            if " " in node:
                open_.append((node[" "], k))
                if k < len(text) and text[k] in " -":
                    open_.append((node[" "], k + 1))
            if k < len(text) and text[k] not in " -" and text[k] in node:
                open_.append((node[text[k]], k + 1))


class Segmenter:
    """concepts_of with its lookups prepared: a trie of the terms in characters, and each term's first concept."""

    def __init__(self, words: Dictionary) -> None:
        groups = [(False, c) for c in words.concepts] + [(True, c) for c in words.soft]
        self.groups = [Group(tuple(terms), soft) for soft, terms in groups]
        self.noise = words.noise
        self.trie = Trie(t for t in [*(t for g in self.groups for t in g.terms), *words.noise] if CJK.search(t))
        self.exact: dict[str, int] = {}
        self.begins: dict[str, int] = {}
        for k, g in enumerate(self.groups):
            for t in g.terms:
                self.exact.setdefault(t, k)
                if not CJK.search(t) and len(t) > 2:
                    self.begins.setdefault(t, k)

    def group(self, token: str) -> Group:
        """The first concept that has the token, or a term that it begins with."""
        found = [self.exact[token]] if token in self.exact else []
        found += [self.begins[token[:n]] for n in range(3, len(token) + 1) if token[:n] in self.begins]
        return self.groups[min(found)] if found else Group((token,))

    def tokens(self, run: str) -> list[tuple[str, str]]:
        """(token, phrase) of a stretch of characters: its longest terms, and pairs of what is unknown."""
        out, unknown, at = [], "", 0
        while at <= len(run):
            term = self.trie.longest(run, at) if at < len(run) else None
            if term or at == len(run):
                out += [(unknown[k : k + 2], unknown) for k in range(len(unknown) - 1)]
                unknown = ""
            if term:
                out.append((term, ""))
                at += len(term)
            else:
                unknown += run[at : at + 1]
                at += 1
        return out

    def segmented(self, query: str | None) -> list[Group]:
        """The concept groups of a query in its order, each first term once."""
        out: dict[str, Group] = {}
        for run in RUN.findall((query or "").lower().strip()):
            for token, phrase in self.tokens(run) if CJK.search(run) else [(run, "")]:
                if token not in self.noise:
                    group = Group((token,), False, phrase) if phrase else self.group(token)
                    out.setdefault(group.terms[0], group)
        return list(out.values())


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, at most ROWS_AT_ONCE at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _shared_out(frame: DataFrame) -> DataFrame:
    """Each row of frame for each share."""
    return frame.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))


def segmented(queries: DataFrame, words: Dictionary = DICTIONARY) -> DataFrame:
    """(qid, GROUP) of queries (qid, query): a row for each concept group in the query's order; null and empty queries have none.

    The dictionary, which is of a fixed size, is sent to each worker once.
    """
    shared = queries.sparkSession.sparkContext.broadcast(words)
    kind = pa.list_(pa.struct([("k", pa.int32()), ("terms", pa.list_(pa.string())), ("soft", pa.bool_()), ("phrase", pa.string())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(shared.value)
        for batch in _few(batches):
            rows = [[{"k": k, "terms": list(g.terms), "soft": g.soft, "phrase": g.phrase} for k, g in enumerate(segmenter.segmented(q))] for q in batch.column("query").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("qid"), pa.array(rows, kind)], ["qid", "groups"])

    qid = queries.schema["qid"].dataType.simpleString()
    return queries.select("qid", "query").mapInArrow(cut, f"qid {qid}, groups array<struct<{GROUP}>>").select("qid", F.inline("groups"))


def hits(rows: DataFrame, terms: list[str], fields: dict[str, int], key: str = "id") -> DataFrame:
    """(key, term, weight): the greatest weight of a field that has the term, as search.term_pattern finds it; a row for each term that a row has."""
    shared = rows.sparkSession.sparkContext.broadcast([t for t in terms if t not in GUARDED])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latin, other = Trie(t for t in shared.value if not CJK.search(t)), Trie(t for t in shared.value if CJK.search(t))

        def terms_of(text: str) -> set[str]:
            out: set[str] = set()
            alone = [not (c.isascii() and c.isalnum()) for c in text] + [True]
            for at, c in enumerate(text):
                if c in other.root:
                    out.update(t for t, _ in other.starting(text, at))
                if c in latin.root and (at == 0 or alone[at - 1]):
                    out.update(t for t, end in latin.starting(text, at) if len(t) > 2 or alone[end])
            return out

        for batch in _few(batches):
            keys, names, weights = [], [], []
            columns = [(batch.column(c).to_pylist(), w) for c, w in fields.items()]
            for k, row in enumerate(batch.column(key).to_pylist()):
                best: dict[str, int] = {}
                for values, w in columns:
                    for t in terms_of((values[k] or "").lower()):
                        best[t] = max(w, best.get(t, w))
                keys += [row] * len(best)
                names += best
                weights += best.values()
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), pa.array(names, pa.string()), pa.array(weights, pa.int64())], [key, "term", "weight"])

    out = rows.select(key, *fields).mapInArrow(found, f"{key} {rows.schema[key].dataType.simpleString()}, term string, weight long")
    for t in terms:
        if t in GUARDED:  # these few look behind
            weight = group_weight([t], fields).cast("long")
            out = out.unionByName(rows.select(key, F.lit(t).alias("term"), weight.alias("weight")).where("weight > 0"))
    return out


def ranked(rows: DataFrame, groups: DataFrame, fields: dict[str, int], key: str = "id", keep: float = 0.5) -> DataFrame:
    """(qid, key, score) for all queries whose groups (qid, GROUP) these are: for each what search.concept_ranked finds for it alone.

    Rows are scanned once for each TERMS_AT_ONCE distinct terms, whose number is that of the queries' words and not of the rows; what a group
    finds is computed once for all queries that have it.
    """
    spark = rows.sparkSession
    path = shared_folder(spark, "groups")
    groups.withColumn("name", F.array_join("terms", "\n")).write.parquet(path)
    groups = spark.read.parquet(path)
    each = groups.select("name", F.explode("terms").alias("term")).distinct()
    terms = [r.term for r in each.select("term").distinct().orderBy("term").toLocalIterator()]
    met = [hits(rows, terms[a : a + TERMS_AT_ONCE], fields, key) for a in range(0, max(1, len(terms)), TERMS_AT_ONCE)]
    found = reduce(DataFrame.unionByName, met).join(each, "term").groupBy("name", key).agg(F.max("weight").alias("weight"))
    path = shared_folder(spark, "hits")
    found.write.parquet(path)
    found = spark.read.parquet(path).withColumn("share", F.pmod(F.xxhash64(key), F.lit(SHARES)).cast("int"))
    df = found.groupBy("name").agg(F.count(F.lit(1)).alias("df"))
    asked = groups.join(df, "name", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # a query that names a concept which no row has finds nothing
    per = asked.groupBy("qid").agg(F.bool_or(~F.col("soft")).alias("hard"), F.bool_and(F.col("soft") | (F.col("phrase") != "") | (F.col("df") > 0)).alias("possible"))
    asked = asked.join(per.where("possible"), "qid").join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("rows"))))  # one row
    idf = F.log(1 + F.col("rows") / (1 + F.col("df"))) * F.when(F.col("soft"), SOFT_FACTOR).otherwise(1.0)
    scored = _shared_out(asked.select("qid", "name", "hard", "soft", idf.alias("idf"))).join(found, ["name", "share"]).groupBy("qid", "share", key)
    scored = scored.agg(F.round(F.sum(F.col("idf") * F.col("weight")), 6).alias("score"), F.bool_or(~(F.col("hard") & F.col("soft"))).alias("some")).where("some and score > 0")
    top = scored.groupBy("qid").agg(F.max("score").alias("top"))
    return scored.join(_shared_out(top), ["qid", "share"]).where(F.col("score") >= keep * F.col("top")).select("qid", key, "score")
