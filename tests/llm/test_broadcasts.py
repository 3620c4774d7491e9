"""What the language model sends to workers."""

from pyspark.sql import functions as F

from tidewire.llm import language_model


def test_words_are_sent_once(spark, monkeypatch):
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(x) or send(x))
    docs = spark.createDataFrame([(k, f"a b {'c d' * (k % 3)} e{k % 4}") for k in range(12)], "doc_id long, text string")
    assert language_model.score_texts(docs, F.col("doc_id") % 5 == 0).count() == 12
    words = [x for x in sent for y in (x if isinstance(x, tuple) else (x,)) if isinstance(y, language_model.Words)]
    assert len(words) == 1
