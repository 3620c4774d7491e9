"""Category cascades, topic tags and relevance gates, over pattern catalogues that are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewire.functions.text import word_edges

# Terms that mark an item as being about AI; one strong or two weak ones suffice.
STRONG_TERMS = (
    "ai 人工智能 大模型 大语言模型 生成式 多模态 神经网络 机器学习 深度学习 智能体 具身智能 文生图 文生视频 视频生成 图像生成 语音识别 llm agi chatbot copilot transformer diffusion embedding rag".split()
    + "machine learning|deep learning|neural network|generative|multimodal|world model|vision language|text-to-image|text-to-video|open-weight|reasoning model|frontier model|foundation model|robotics|机器人".split("|")
    + "openai|anthropic|deepseek|mistral|midjourney|hugging face|huggingface|stability ai|perplexity|智谱|moonshot|月之暗面|百川|baichuan|minimax|阶跃星辰|零一万物|面壁|xai|ssi|safe superintelligence".split("|")
    + "gpt|chatgpt|claude|gemini|llama|qwen|通义|千问|文心|豆包|doubao|kimi|glm|grok|sora|stable diffusion|dall-e|dall·e|o1|o3|veo|imagen|flux|hunyuan|混元|cursor|devin|manus|notebooklm|nano banana|yi-".split("|")
    + "微调|fine-tun|蒸馏|distillation|强化学习|rlhf|prompt|提示词|预训练|pretrain|post-train|开源模型|moe|mixture of experts|扩散模型|端侧模型|推理模型|vibe coding".split("|")
)
WEAK_TERMS = "模型 训练 推理 算力 gpu 芯片 nvidia 英伟达 cuda agent 智能 tpu inference benchmark 开源 token 算法".split()
WHOLE_WORDS = set("ai agent gpt llm agi moe o1 o3 tpu token grok veo flux ssi".split())


def has_term(text: Column, term: str, whole: set[str] = WHOLE_WORDS) -> Column:
    """Whether lower-cased text has a term: as a word if it is in `whole`, else anywhere."""
    return text.rlike(word_edges(f"\\b{term}\\b")) if term in whole else F.contains(text, F.lit(term))


def relevant(text: Column, strong: list[str] = STRONG_TERMS, weak: list[str] = WEAK_TERMS, whole: set[str] = WHOLE_WORDS) -> Column:
    """One strong term or two different weak ones."""
    low = F.lower(text)
    import re

    raw = "|".join(re.escape(t) for t in strong if t not in whole)
    words = "|".join(t for t in strong if t in whole)
    hit = low.rlike(raw) if raw else F.lit(False)
    hit = hit | low.rlike(word_edges(f"\\b(?:{words})\\b")) if words else hit
    return hit | (sum((has_term(low, t, whole).cast("int") for t in weak), F.lit(0)) >= 2)


def first_match(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for name, rule in rules:
        rule = F.coalesce(rule, F.lit(False))
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out.otherwise(otherwise)


def tags(text: Column, catalogue: dict[str, str]) -> Column:
    """Names of all patterns that text matches, in catalogue order."""
    return F.filter(F.array(*(F.when(text.rlike(word_edges(p)), F.lit(n)) for n, p in catalogue.items())), lambda t: t.isNotNull())


def tag_counts(items: DataFrame, column: str = "tags") -> DataFrame:
    return items.select(F.explode(column).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


# The longest of each text, and of tags.
LONGEST = {"id": 200, "title": 300, "summary": 2000, "source": 100, "ai_note": 300}
LONGEST_URL, LONGEST_TAG, MOST_TAGS = 2048, 50, 20


def safe_url(c: Column, https_only: bool = False) -> Column:
    """A trimmed URL of http or https, or https only, of at most 2048 characters; else null."""
    url = F.trim(c)
    return F.when(url.rlike("^https://" if https_only else "^https?://") & (F.length(url) <= LONGEST_URL), url)


#: What an item must have after its fields are mended, in the order in which a missing one is named.
REQUIRED = ("id", "title", "source", "source_url")


def sanitised(items: DataFrame) -> DataFrame:
    """Items with an id, a title, a source and an http(s) URL; fields are trimmed and cut, bad numbers and times mended.

    Heat is 0 where it isn't a number from 0; engagement, times, and images without https are null where they are bad; empty
    tags go.  A column that items lack is left out.
    """
    return mended(items).where(" and ".join(f"{c} is not null" for c in REQUIRED))


def observed(items: DataFrame, name: str = "sanitiser") -> tuple[DataFrame, Observation]:
    """(sanitised items, observation): once an action has run on the items, observation.get has n, kept, and no_<column> of
    those dropped for a column, the first that they lack.  Nothing is scanned twice."""
    seen = Observation(name)
    return with_metrics(mended(items), seen), seen


def observed_stream(items: DataFrame, name: str = "sanitiser") -> DataFrame:
    """The same of a stream: each batch's metrics are in its progress, under the name."""
    return with_metrics(mended(items), name)


def with_metrics(rows: DataFrame, seen: Observation | str) -> DataFrame:
    """Mended rows that have all they must, counted on the way."""
    lacks = F.lit(None).cast("string")
    for c in reversed(REQUIRED):
        lacks = F.when(F.col(c).isNull(), c).otherwise(lacks)
    counts = [F.count_if(F.coalesce(lacks == c, F.lit(False))).alias(f"no_{c}") for c in REQUIRED]
    return rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(lacks.isNull()).alias("kept"), *counts).where(lacks.isNull())


def mended(items: DataFrame) -> DataFrame:
    """Items with their fields mended, those that lack what they must too."""
    from tidewire.functions.text import clamped, half_up

    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    number, heat = F.col("engagement").cast("double"), F.col("heat").cast("double") if "heat" in items.columns else F.lit(0.0)
    cut = {c: clamped(F.col(c), n) for c, n in LONGEST.items() if c in items.columns and (c != "id" or items.schema["id"].dataType.simpleString() == "string")}
    fields = {
        **cut,
        "source_url": safe_url(F.col("source_url")),
        "engagement": F.when(finite(number) & (number > 0), half_up(number)),
        **{c: F.when(F.try_to_timestamp(c).isNotNull(), F.col(c)) for c in ("published_at", "first_seen", "fetched_at") if c in items.columns},
    }
    if "heat" in items.columns:
        fields["heat"] = F.when(finite(heat) & (heat >= 0), half_up(heat)).otherwise(0)
    if "image" in items.columns:
        fields["image"] = safe_url(F.col("image"), https_only=True)
    if "tags" in items.columns:
        fields["tags"] = F.transform(F.slice(F.filter("tags", lambda t: F.trim(t) != ""), 1, MOST_TAGS), lambda t: F.substring(F.trim(t), 1, LONGEST_TAG))
    return items.withColumns(fields)


def dropped(items: DataFrame) -> DataFrame:
    """One row (kept, dropped): how many items the sanitiser keeps and drops."""
    kept = sanitised(items).agg(F.count(F.lit(1)).alias("kept"))
    return items.agg(F.count(F.lit(1)).alias("n")).join(kept).select("kept", (F.col("n") - F.col("kept")).alias("dropped"))


def in_dimension(category: Column, known: list[str]) -> Column:
    """Whether a category is set and known."""
    return F.coalesce(category.isin(known), F.lit(False))
