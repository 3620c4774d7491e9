"""Search: keyword scores for retrieval, concept ranking and strict re-ranking."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of a hit by field.
FIELD_WEIGHTS = {"name": 5, "tags": 4, "topics": 3, "note": 3, "description": 2, "extra": 1}


def retrieved(items: DataFrame, query: str, limit: int = 15) -> DataFrame:
    """Items by score: 10 for the query in the title; for each word 5 in the title, 2 in the summary and in the note, 3 in the source; up to 3 for heat."""
    low = query.lower()
    words = [w for w in low.split() if len(w) >= 2]

    def points(field: str, text: str, n: int) -> Column:
        return F.when(F.contains(F.lower(F.coalesce(field, F.lit(""))), F.lit(text)), n).otherwise(0)

    score = points("title", low, 10)
    for w in words:
        score = score + points("title", w, 5) + points("summary", w, 2) + points("source", w, 3)
        if "ai_note" in items.columns:
            score = score + points("ai_note", w, 2)
    score = score + F.least(F.coalesce("heat", F.lit(0)) / 40.0, F.lit(3.0))
    return items.withColumn("score", F.round(score, 6)).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


# Guards of terms that also say what a thing is made for, and topics that say nothing about a repository.
GUARDED = {"设计": "(?<!为[^，。；,.;]{0,14})设计", "design": "(^|[^a-z0-9])design(?!ed)"}
VAGUE_TOPICS = (
    "ai llm llms agent agents ai-agent ai-agents agentic agentic-ai claude claude-code openai anthropic gpt chatgpt gemini codex "
    "python typescript javascript rust go golang nodejs react nextjs cli tool tools open-source opensource awesome machine-learning deep-learning "
    "generative-ai genai artificial-intelligence mcp skills automation framework sdk api self-hosted local-first"
).split()
AI_WORDS = "^(agent|agentic|llm|model|rag|mcp|prompt|gpt|claude|copilot|diffusion|inference|world model)"
CJK = re.compile("[\u4e00-\u9fff]")
SOFT_FACTOR, WIDE_DAYS, WIDE_STARS = 0.4, 180, 100


@dataclass(frozen=True)
class Group:
    """Ways to say one thing.  soft: it ranks but isn't required; phrase: the unknown wording that a pair of characters was cut from."""

    terms: tuple[str, ...]
    soft: bool = False
    phrase: str = ""


@dataclass(frozen=True)
class Dictionary:
    """Concepts (each a list of terms in both languages), soft ones, words without meaning, and full forms of stems."""

    concepts: list[list[str]]
    soft: list[list[str]] = field(default_factory=list)
    noise: frozenset[str] = frozenset()
    whole: dict[str, str] = field(default_factory=dict)

    def group(self, token: str) -> Group:
        """The first concept that has the token, or a term of three letters or more that it begins with."""
        for soft, groups in ((False, self.concepts), (True, self.soft)):
            for terms in groups:
                if any(t == token or (not CJK.search(t) and len(t) > 2 and token.startswith(t)) for t in terms):
                    return Group(tuple(terms), soft)
        return Group((token,))


def concepts_of(query: str, words: Dictionary) -> list[Group]:
    """The concept groups of a query in its order.  Stretches of characters are cut at the longest known terms; what is unknown becomes pairs of characters."""
    known = sorted((t for t in [*(t for g in [*words.concepts, *words.soft] for t in g), *words.noise] if CJK.search(t)), key=lambda t: (-len(t), t))
    known_pattern = "|".join(map(re.escape, known))
    found: list[Group] = []
    for run in re.findall("[a-z0-9][a-z0-9.+#-]*|[\u4e00-\u9fff]+", query.lower().strip()):
        if not CJK.search(run):
            tokens = [(run, "")]
        else:
            tokens = []
            for part in re.split(f"({known_pattern})", run) if known else [run]:
                if part in known:
                    tokens.append((part, ""))
                else:
                    tokens.extend((part[i : i + 2], part) for i in range(len(part) - 1))
        for token, phrase in tokens:
            if token not in words.noise:
                group = Group((token,), False, phrase) if phrase else words.group(token)
                if all(g.terms[0] != group.terms[0] for g in found):
                    found.append(group)
    return found


def term_pattern(term: str) -> str:
    """A pattern for a term: Latin ones as word beginnings, or whole words up to two letters; spaces and hyphens are optional."""
    if term in GUARDED:
        return GUARDED[term]
    if CJK.search(term):
        return re.escape(term)
    body = "[ -]?".join(re.escape(x) for x in re.split(r"[ -]", term))
    return f"(?<![a-z0-9]){body}" + ("(?![a-z0-9])" if len(term) <= 2 else "")


def group_weight(terms, fields: dict[str, int]) -> Column:
    """The greatest weight of a field that has one of the terms, or 0."""
    pattern = "|".join(term_pattern(t) for t in terms)
    return F.greatest(F.lit(0), *(F.when(F.lower(F.coalesce(c, F.lit(""))).rlike(pattern), w).otherwise(0) for c, w in fields.items()))


def concept_ranked(rows: DataFrame, groups: list, fields: dict[str, int], key: str = "id", keep: float = 0.5) -> DataFrame:
    """Rows by the sum over concept groups (Group, or a list of terms) of idf times the best field weight; (key, score).

    idf is ln(1 + N / (1 + df)), 0.4 of it for soft groups, which qualify no row if there are others.  Nothing is found if a
    named concept has no row; pairs of an unknown phrase need none.  Rows below half the top score are left out.
    """
    groups = [g if isinstance(g, Group) else Group(tuple(g)) for g in groups]
    if not groups:
        return rows.where("false").select(key, F.lit(0.0).alias("score"))
    found = rows.select(key, *(group_weight(g.terms, fields).alias(f"h{k}") for k, g in enumerate(groups)))
    counts = found.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(f"h{k}") > 0).alias(f"df{k}") for k in range(len(groups))))
    both = found.join(F.broadcast(counts))  # one row
    every, some, score = F.lit(True), F.lit(False), F.lit(0.0)
    hard = any(not g.soft for g in groups)
    for k, g in enumerate(groups):
        if not g.soft and not g.phrase:
            every = every & (F.col(f"df{k}") > 0)
        if not (hard and g.soft):
            some = some | (F.col(f"h{k}") > 0)
        score = score + F.log(1 + F.col("n") / (1 + F.col(f"df{k}"))) * (SOFT_FACTOR if g.soft else 1.0) * F.col(f"h{k}")
    scored = both.where(every & some).select(key, F.round(score, 6).alias("score")).where("score > 0")
    top = scored.agg(F.max("score").alias("top"))
    return scored.join(F.broadcast(top)).where(F.col("score") >= keep * F.col("top")).select(key, "score")


def ordered_by_stars(found: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Ranked rows by score, then stars."""
    return found.join(rows.select(key, "stars"), key).orderBy(F.desc("score"), F.desc("stars"), key)


def topic_counts(rows: DataFrame, pairs: list[Group], fields: dict[str, int], least: int = 3) -> DataFrame:
    """(topic, n): telling topics of rows that have half or more of a phrase's pairs in a field of weight 3 or more, the most frequent first."""
    hits = sum((group_weight(g.terms, fields) >= least).cast("int") for g in pairs)
    some = rows.where(hits >= max(1, -(-len(pairs) // 2))).select(F.explode("topics").alias("topic")).where(~F.col("topic").isin(VAGUE_TOPICS))
    return some.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic")


def wide_keywords(groups: list[Group], words: Dictionary, rows: DataFrame | None = None, fields: dict[str, int] | None = None) -> list[str]:
    """English keywords of a query for a search elsewhere; an unknown phrase gives the most frequent telling topic of rows that have it.

    Only the first row of topic_counts comes to the driver.
    """
    out, phrases = [], {}
    for g in groups:
        if g.phrase:
            phrases.setdefault(g.phrase, []).append(g)
        elif not g.soft:
            k = next((t for t in g.terms if not CJK.search(t)), g.terms[0])
            out.append(words.whole.get(k, k))
    for phrase, pairs in phrases.items():
        best = topic_counts(rows, pairs, fields).first() if rows is not None else None
        out.append(best.topic.replace("-", " ") if best else phrase)
    latin = [k for k in out if not CJK.search(k)]
    return list(dict.fromkeys(w for k in latin or out for w in k.split(" ")))


def wide_query(keywords: list[str], today: str) -> str | None:
    """A repository search for keywords: about AI, with stars, and pushed to in the last half year."""
    if not keywords:
        return None
    words = keywords if any(re.match(AI_WORDS, k) for k in keywords) else [*keywords, "ai"]
    since = date.fromisoformat(today[:10]) - timedelta(days=WIDE_DAYS)
    return f"{' '.join(words)} in:name,description,topics stars:>{WIDE_STARS} pushed:>{since}"


def fuzzy_found(items: DataFrame, query: str, limit: int = 8, key: str = "id") -> DataFrame:
    """(key, score) of the items best matched by a query's words, over title (twice), summary and source.

    A word of an item matches a word of the query that it begins with, or that differs from it by a fifth of the letters or fewer.  Each
    match counts the inverse frequency of its word; beginnings and misspellings count less the farther off they are.  The order of close
    scores is our own: no public formula fixes it.
    """
    terms = list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    if not terms:
        return items.where("false").select(key, F.lit(0.0).alias("score"))
    split = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))
    parts = [items.select(key, F.lit(w).alias("weight"), F.explode(split(c)).alias("word")) for c, w in (("title", 2.0), ("summary", 1.0), ("source", 1.0)) if c in items.columns]
    words = reduce(DataFrame.unionByName, parts)
    near = []
    for k, t in enumerate(terms):
        far = round(0.2 * len(t))
        closeness = F.when(F.col("word") == t, 1.0).when(F.col("word").startswith(t), 0.375 * len(t) / F.length("word"))
        if far:
            gap = F.levenshtein("word", F.lit(t), far)
            closeness = closeness.when((gap >= 0) & (F.abs(F.length("word") - len(t)) <= far), 0.45 * len(t) / (len(t) + gap))
        near.append(F.struct(F.lit(k).alias("term"), closeness.alias("close")))
    met = words.groupBy(key, "word").agg(F.sum("weight").alias("weight"))
    met = met.select(key, "word", "weight", F.explode(F.filter(F.array(*near), lambda x: x["close"].isNotNull())).alias("hit"))
    df = met.groupBy("word").agg(F.count_distinct(key).alias("df"))
    total = items.agg(F.count(F.lit(1)).alias("n"))
    each = met.join(df, "word").join(F.broadcast(total))  # one row
    score = F.col("weight") / (F.col("weight") + 1.2) * F.col("hit.close") * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return each.groupBy(key).agg(F.round(F.sum(score), 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def reranked(rows: DataFrame, groups: list, fields: dict[str, int], key: str = "id") -> DataFrame:
    """Rows that every concept hits, by the sum of their best field weights."""
    named = [g.terms if isinstance(g, Group) else g for g in groups if not isinstance(g, Group) or not (g.soft or g.phrase)]
    total, every = F.lit(0), F.lit(True)
    for terms in named:
        weight = group_weight(terms, fields)
        total, every = total + weight, every & (weight > 0)
    return rows.where(every).select(key, total.cast("long").alias("score"))


def context_lines(items: DataFrame) -> DataFrame:
    """A numbered line of each retrieved item for a prompt."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    return items.select("id", F.concat_ws(" ", F.concat(F.lit("["), n.cast("string"), F.lit("]")), "title", F.concat(F.lit("("), "source", F.lit(")"))).alias("line"))
