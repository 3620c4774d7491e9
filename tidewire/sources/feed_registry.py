"""The registry of feeds: a dimension of what is crawled, and the choice of a part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The feeds, as (name, url, source, category where the words of an item give none, tier, only items about AI, titles end with a publisher).
FEEDS = (
    ("openai", "https://openai.com/news/rss.xml", "OpenAI", "ai-models", 1, False, False),
    ("anthropic", "https://news.google.com/rss/search?q=site:anthropic.com&hl=en-US&gl=US&ceid=US:en", "Anthropic", "ai-models", 1, False, True),
    ("meta-ai", "https://news.google.com/rss/search?q=site:ai.meta.com&hl=en-US&gl=US&ceid=US:en", "Meta AI", "ai-models", 1, False, True),
    ("google-ai", "https://blog.google/technology/ai/rss/", "Google AI", "ai-models", 1, False, False),
    ("deepmind", "https://deepmind.google/blog/rss.xml", "Google DeepMind", "ai-models", 1, False, False),
    ("google-research", "https://research.google/blog/rss/", "Google Research", "paper", 1, True, False),
    ("nvidia", "https://blogs.nvidia.com/feed/", "NVIDIA", "ai-models", 1, True, False),
    ("hf-blog", "https://huggingface.co/blog/feed.xml", "HuggingFace Blog", "tip", 1, False, False),
    ("mistral", "https://mistral.ai/rss.xml", "Mistral AI", "ai-models", 1, False, False),
    ("cohere", "https://cohere.com/blog/rss.xml", "Cohere", "ai-models", 1, False, False),
    ("qwen", "https://qwenlm.github.io/blog/index.xml", "通义千问 Qwen", "ai-models", 1, False, False),
    ("apple-ml", "https://machinelearning.apple.com/rss.xml", "Apple ML Research", "paper", 1, False, False),
    ("bair", "https://bair.berkeley.edu/blog/feed.xml", "Berkeley AI Research", "paper", 1, False, False),
    ("mit-news-ai", "https://news.mit.edu/topic/mitartificial-intelligence2-rss.xml", "MIT News", "industry", 1, False, False),
    ("msr", "https://www.microsoft.com/en-us/research/feed/", "Microsoft Research", "paper", 1, True, False),
    ("aws-ml", "https://aws.amazon.com/blogs/machine-learning/feed/", "AWS ML", "tip", 2, False, False),
    ("theverge-ai", "https://www.theverge.com/rss/ai-artificial-intelligence/index.xml", "The Verge", "industry", 2, False, False),
    ("techcrunch-ai", "https://techcrunch.com/category/artificial-intelligence/feed/", "TechCrunch", "industry", 2, False, False),
    ("venturebeat-ai", "https://venturebeat.com/category/ai/feed/", "VentureBeat", "industry", 2, False, False),
    ("arstechnica-ai", "https://arstechnica.com/ai/feed/", "Ars Technica", "industry", 2, False, False),
    ("techreview-ai", "https://www.technologyreview.com/topic/artificial-intelligence/feed", "MIT Tech Review", "industry", 2, False, False),
    ("wired-ai", "https://www.wired.com/feed/tag/ai/latest/rss", "Wired", "industry", 2, False, False),
    ("thedecoder", "https://the-decoder.com/feed/", "The Decoder", "industry", 2, False, False),
    ("marktechpost", "https://www.marktechpost.com/feed/", "MarkTechPost", "paper", 2, False, False),
    ("semianalysis", "https://semianalysis.com/feed/", "SemiAnalysis", "industry", 2, False, False),
    ("smol-ainews", "https://news.smol.ai/rss.xml", "AI News", "tip", 2, False, False),
    ("tldr-ai", "https://tldr.tech/api/rss/ai", "TLDR AI", "industry", 2, False, False),
    ("simonwillison", "https://simonwillison.net/atom/everything/", "Simon Willison", "tip", 2, True, False),
    ("lilianweng", "https://lilianweng.github.io/index.xml", "Lilian Weng", "tip", 2, False, False),
    ("raschka", "https://magazine.sebastianraschka.com/feed", "Sebastian Raschka", "tip", 2, False, False),
    ("thegradient", "https://thegradient.pub/rss/", "The Gradient", "tip", 2, True, False),
    ("importai", "https://jack-clark.net/feed/", "Import AI", "tip", 2, False, False),
    ("interconnects", "https://www.interconnects.ai/feed", "Interconnects", "tip", 2, False, False),
    ("latentspace", "https://www.latent.space/feed", "Latent Space", "tip", 2, False, False),
    ("oneusefulthing", "https://www.oneusefulthing.org/feed", "Ethan Mollick", "tip", 2, False, False),
    ("bensbites", "https://www.bensbites.com/feed", "Ben's Bites", "tip", 2, False, False),
    ("qbitai", "https://www.qbitai.com/feed", "量子位", "ai-products", 3, False, False),
    ("jiqizhixin", "https://wechat2rss.xlab.app/feed/51e92aad2728acdd1fda7314be32b16639353001.xml", "机器之心", "ai-products", 3, False, False),
    ("xinzhiyuan", "https://wechat2rss.xlab.app/feed/ede30346413ea70dbef5d485ea5cbb95cca446e7.xml", "新智元", "industry", 3, False, False),
    ("geekpark", "https://wechat2rss.xlab.app/feed/1a5aec98e71c707c8ca092bc2c255b9d4bac477d.xml", "极客公园", "industry", 3, True, False),
    ("36kr", "https://36kr.com/feed", "36氪", "industry", 3, True, False),
    ("infoq", "https://www.infoq.cn/feed", "InfoQ", "industry", 3, True, False),
    ("sspai", "https://sspai.com/feed", "少数派", "ai-products", 3, True, False),
    ("ithome", "https://www.ithome.com/rss/", "IT之家", "industry", 3, True, False),
)
SCHEMA = "feed string, url string, source string, category string, tier int, ai_only boolean, strip_source boolean"
#: Before the name in the id of a feed's adapter.
PREFIX = "rss:"


def registry(spark: SparkSession) -> DataFrame:
    """One row of SCHEMA for each feed; feed is the adapter's id."""
    return spark.createDataFrame([(PREFIX + name, *rest) for name, *rest in FEEDS], SCHEMA)


def chosen(feed: str, only: list[str]) -> bool:
    """Whether an adapter's id is, or begins with, one of these; all are if there are none."""
    return not only or any(feed.startswith(o) for o in only)
