"""What the queries of the index read of each text."""

import duckdb

from tidewire.plans import registry, services  # noqa: F401


def test_compacted_index_knows_whole_texts(spark, tmp_path):
    texts = [f"title{k} first\nsecond line of {k}\n" + "filler " * 300 + f"last{k} {'rare' if k % 2 else 'seldom'}" for k in range(12)] + [None, "", "\nrare"]
    spark.createDataFrame([(k, t, f"src{k % 3}") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    asked = ["rare", "seldom", "last7 second", "title4", "filler"]
    spark.createDataFrame([(k, 0, t) for k, t in enumerate(asked)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.qid, r.id, r.score, r.place) for r in registry.QUERIES["index_compacted"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == {tuple(r) for r in con.execute(registry.ORACLE_SQL["index_compacted"]).fetchall()}
    # words of a last line find every item that has them and isn't deleted
    assert {i for q, i, *_ in got if q == 0} == {1, 3, 7, 9, 11, 14} and {i for q, i, *_ in got if q == 1} == {2, 4, 6, 8}
