from pyspark.sql import functions as F

from tidewire.operators import news

ITEMS = "id long, title string, summary string, origin string, published_at string, source_url string"


def test_names_of_one_word_are_decided_without_patterns(spark, monkeypatch):
    rows = [(k, f"Item {k} that came with news", None, None, f"2024-01-{k + 1:02}T00:00:00", None) for k in range(9)] + [(9, "nothing; thatwith", None, None, "2024-01-30T00:00:00", None)]
    repos = spark.createDataFrame([("with/that",), ("none/that",)], "full_name string")
    monkeypatch.setattr(news, "word_pattern", lambda c: F.lit("(?!)"))
    got = news.matched(spark.createDataFrame(rows, ITEMS), repos, "2024-01-31T00:00:00")
    assert sorted(tuple(r) for r in got.collect()) == sorted(("with/that", 8 - k, k + 1) for k in range(5))


def test_names_of_several_words_full_names_and_other_scripts_still_meet_patterns(spark):
    texts = ["acme builds big-model", "acme builds big and model", "see mcp/mcp now", "mcp mcp", "hello 大模型引擎 by zhang", "google ai ships deep learner", "tool2go is out", "tool2 go"]
    rows = [(k, t, None, None, f"2024-01-{k + 1:02}T00:00:00", None) for k, t in enumerate(texts)]
    repos = spark.createDataFrame([("acme/big-model",), ("mcp/mcp",), ("zhang/大模型引擎",), ("googleai/deep-learner",), ("x/tool2go",)], "full_name string")
    got = news.matched(spark.createDataFrame(rows, ITEMS), repos, "2024-01-31T00:00:00")
    assert sorted(tuple(r) for r in got.collect()) == [("acme/big-model", 0, 1), ("googleai/deep-learner", 5, 1), ("mcp/mcp", 2, 1), ("x/tool2go", 6, 1), ("zhang/大模型引擎", 4, 1)]
