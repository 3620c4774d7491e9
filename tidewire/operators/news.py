"""News about repositories: links, full names, and names together with their owners."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import word_edges
from tidewire.lineage import shared_folder

WINDOW_DAYS, MOST = 45, 5
#: Origins whose items are repositories or papers themselves.
NOT_NEWS = ("github", "hf-papers")
# What owners are called in the news.
OWNER_ALIASES = {
    "anthropics": ["anthropic"],
    "openai": ["openai"],
    "google": ["google", "谷歌"],
    "google-deepmind": ["deepmind", "google"],
    "google-research": ["google"],
    "googlecloudplatform": ["google"],
    "microsoft": ["microsoft", "微软"],
    "facebookresearch": ["meta"],
    "meta-llama": ["meta"],
    "nvidia": ["nvidia", "英伟达"],
    "nvlabs": ["nvidia", "英伟达"],
    "tencent": ["tencent", "腾讯"],
    "tencentarc": ["tencent", "腾讯"],
    "tencentcloud": ["tencent", "腾讯"],
    "tencent-hunyuan": ["tencent", "腾讯", "混元"],
    "alibaba": ["alibaba", "阿里"],
    "qwenlm": ["qwen", "通义", "千问"],
    "baidu": ["baidu", "百度"],
    "bytedance": ["bytedance", "字节"],
    "deepseek-ai": ["deepseek"],
    "huggingface": ["hugging face", "huggingface"],
    "heygen-com": ["heygen"],
}
# Names that say nothing without a link, and endings of owners that are no part of their names.
GENERIC = "skills agents agent router plugins coder atlas orca up ax bend substrate harness memory macro fabric openvino cookbook rag mcp".split()
ENDINGS = "ai|io|hq|inc|org|dev|labs?|team|app|com"


def quoted(c: Column) -> Column:
    """Text as a pattern for itself."""
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def word_pattern(term: Column) -> Column:
    """A pattern for a term: ASCII ones as words whose spaces may be blanks, hyphens, underscores or nothing, others anywhere."""
    body = F.replace(quoted(term), F.lit(" "), F.lit("[\\s_-]?"))
    edge = word_edges("\\b")
    return F.when(term.rlike("^[\\x00-\\x7F]+$"), F.concat(F.lit(edge), body, F.lit(edge))).otherwise(quoted(term))


def owner_terms(owner: Column, name: Column) -> Column:
    """What counts as a mention of an owner: known aliases, or else its handle and that without its ending, of three characters or more and other than the name."""
    aliases = F.create_map(*chain.from_iterable((F.lit(k), F.array(*map(F.lit, v))) for k, v in OWNER_ALIASES.items()))
    spaced = lambda c: F.regexp_replace(c, "[-_]+", " ")
    base = F.regexp_replace(owner, f"[-_](?:{ENDINGS})$", "")
    own = F.array_distinct(F.array(F.regexp_replace(spaced(owner), "(?<=[A-Za-z0-9_]{4})ai$", " ai"), spaced(base)))
    return F.coalesce(F.try_element_at(aliases, owner), F.filter(own, lambda t: (F.length(t) >= 3) & (t != name)))


def _spellings(words: Column) -> Column:
    """Tokens that a name of several words may begin with: its first words, joined by nothing or an underscore."""
    def grown(acc, w):
        last = F.concat(F.transform(acc["last"], lambda x: F.concat(x, w)), F.transform(acc["last"], lambda x: F.concat(x, F.lit("_"), w)))
        return F.struct(F.concat(acc["every"], last).alias("every"), last.alias("last"))

    first = F.slice(words, 1, 1)
    return F.aggregate(F.slice(words, 2, 4), F.struct(first.alias("every"), first.alias("last")), grown, lambda acc: acc["every"])


def matched(items: DataFrame, repos: DataFrame, now: str, days: int = WINDOW_DAYS, most: int = MOST) -> DataFrame:
    """(repo, id, rank): the newest items of the last days that tell of each repository (full_name).

    An item does if it links to the repository, names owner/name, or has the name and a term of the owner; a distinctive name
    (inner capital or digit, six characters) suffices.  Generic or short names, and those of their owner, need a link or the full name.
    Repositories meet items by the links and the words of both.  Names and terms of one word are decided by that alone; a
    pattern is tried on a text only where they leave it open, and where the item is newer than as many that are certain.
    """
    owner, name = F.lower(F.substring_index("full_name", "/", 1)), F.substring_index("full_name", "/", -1)
    plain = F.lower(F.trim(F.regexp_replace(name, "[-_.]+", " ")))
    generic = plain.isin(GENERIC) | (F.length(plain) < 4) | (F.lower(name) == owner)
    ascii, word = lambda c: c.rlike("^[\\x00-\\x7F]+$"), lambda c: c.rlike("^[a-z0-9_]+$")
    terms, none = owner_terms(owner, plain), F.array().cast("array<string>")
    # all words of an ASCII full name stand alone in a text that has it
    whole = F.when(ascii(F.col("full_name")), F.array_distinct(F.regexp_extract_all(F.lower("full_name"), F.lit("[a-z0-9_]+"), F.lit(0)))).otherwise(F.filter(F.array(F.regexp_extract(owner, "[a-z0-9_]+", 0)), lambda t: t != ""))
    r = repos.select(
        F.lower("full_name").alias("repo"),
        word_pattern(F.lower("full_name")).alias("full"),
        F.when(~generic, word_pattern(plain)).alias("name"),
        (~generic & (F.length(name) >= 6) & (name.rlike("[a-z][A-Z]") | name.rlike("[0-9]"))).alias("distinctive"),
        F.array_join(F.transform(terms, word_pattern), "|").alias("owners"),
        F.when(generic, "none").when(word(plain), "word").when(ascii(plain), "words").otherwise("other").alias("kind"),
        F.exists(terms, lambda t: ~word(t)).alias("open"),
        F.size(whole).alias("wholes"),
        F.when(generic, none).otherwise(F.array_distinct(_spellings(F.split(plain, " ")))).alias("n"),
        F.array_distinct(F.filter(terms, word)).alias("o"),
        whole.alias("w"),
    ).dropDuplicates(["repo"])
    path = shared_folder(repos.sparkSession, "names")  # read back, so that Spark knows how large it is
    r.write.parquet(path)
    r = repos.sparkSession.read.parquet(path)
    date = F.coalesce("published_at", "first_seen") if "first_seen" in items.columns else F.col("published_at")
    recent = items.where(~F.coalesce(F.col("origin").isin(*NOT_NEWS), F.lit(False))).where(F.try_to_timestamp(date) >= F.to_timestamp(F.lit(now)) - F.expr(f"interval {days} days"))
    text = F.lower(F.concat_ws(" ", "title", F.coalesce("summary", F.lit(""))))
    recent = recent.select("id", date.alias("date"), F.lower("source_url").alias("url"), text.alias("text"))
    linked = recent.select("id", "date", F.explode(F.array_distinct(F.regexp_extract_all("url", F.lit("github\\.com/([^/#?]+/[^/#?]+)"), F.lit(1)))).alias("repo"))
    links = linked.join(r.select("repo"), "repo").select("repo", "id", "date")
    words = recent.select("id", "date", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z0-9_]+"), F.lit(0)))).alias("token"))

    def having(role: str) -> Column:
        return F.transform(role, lambda t: F.struct(t.alias("token"), F.lit(role).alias("role")))

    roles = F.flatten(F.array(*map(having, "now")))
    met = words.join(r.select("repo", F.inline(roles)), "token").groupBy("repo", "id").agg(F.first("date").alias("date"), F.bool_or(F.col("role") == "n").alias("n"), F.bool_or(F.col("role") == "o").alias("o"), F.count_if(F.col("role") == "w").alias("w"))
    met = met.join(r.select("repo", "full", "name", "distinctive", "owners", "kind", "open", "wholes"), "repo")
    certain = (F.col("kind") == "word") & F.col("n") & (F.col("distinctive") | F.col("o"))
    named = (F.col("n") | (F.col("kind") == "other")) & (F.col("kind") != "none") & (F.col("distinctive") | F.col("o") | F.col("open"))
    met = met.select("*", certain.alias("certain")).where(certain | (F.col("w") >= F.col("wholes")) | named)
    path = shared_folder(repos.sparkSession, "met")
    met.drop("n", "o", "w", "wholes", "open").write.parquet(path)
    met = repos.sparkSession.read.parquet(path)

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("date"), "id"))
        return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)

    sure = best(met.where("certain").select("repo", "id", "date").unionByName(links).dropDuplicates(["repo", "id"]))
    enough = sure.where(F.col("rank") == most).select("repo", F.col("date").alias("least"))
    tried = met.where("not certain").join(enough, "repo", "left").where("least is null or date >= least")
    # the patterns go to the texts, so that a text moves once however many repositories it meets
    tried = tried.groupBy("id").agg(F.collect_list(F.struct("repo", "full", "name", "distinctive", "owners")).alias("repos"))

    def tells(x: Column) -> Column:
        has_full = (F.contains(x["repo"], F.lit(" ")) | F.contains(F.col("text"), x["repo"])) & F.rlike("text", x["full"])
        return has_full | F.coalesce(F.rlike("text", x["name"]), F.lit(False)) & (x["distinctive"] | ((x["owners"] != "") & F.rlike("text", x["owners"])))

    told = recent.join(tried, "id").select("id", "date", F.explode(F.filter("repos", tells)).alias("x"))
    found = told.select("x.repo", "id", "date").unionByName(sure.select("repo", "id", "date")).dropDuplicates(["repo", "id"])
    return best(found).select("repo", "id", "rank")
