import random

from tidewire.llm import kernels, pieces


def made():
    rng = random.Random(8)
    vocab = ["".join(rng.choices("aeionrstlh", k=rng.randrange(2, 9))) for _ in range(400)]
    item = " ".join(rng.choices(vocab, k=20))
    docs, labels = [], []
    for i in range(300):
        w = rng.choices(vocab, k=rng.randrange(20, 80))
        if i % 6 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["moron", "idiot"]))
        labels.append((i, int(i % 6 == 0)))
        docs.append((i, " ".join(w), "en", "s", 1, "x"))
    docs += [(1000 + k, docs[k][1], "en", "s", 1, "y") for k in (1, 2, 3)]
    docs += [(2000, " ".join(rng.choices(vocab, k=60)) + " " + item, "en", "s", 1, None), (2001, docs[5][1] + " token=abcdef123456", "en", "s", 1, None), (2002, None, None, None, None, None), (2003, "", "en", "s", 0, "")]
    return docs, labels, [(1, item)]


def test_each_stage_takes_effect(spark, tmp_path):
    import corpus_pipeline as C

    docs, labels, items = made()
    d = str(tmp_path)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    frame.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in C.STAGES:
        now = kernels.kept(stage(spark, now, d), name)
        seen.append((name, {r.doc_id: r for r in now.collect()}, now.columns))
    by = {name: rows for name, rows, _ in seen}
    assert all(c == frame.columns for _, _, c in seen[:-1])
    toxic = {i for i, t in labels if t}
    assert len(toxic & by["toxicity"].keys()) <= 2 and len(by["toxicity"].keys() - toxic) == len(docs) - len(toxic)
    assert not {1001, 1002, 1003, 1000} & (by["near_dedup"].keys() - {1000}) and {1, 2, 3, 2002, 2003} <= by["near_dedup"].keys()
    assert items[0][1] in by["near_dedup"][2000].text and items[0][1] not in by["decontaminate"][2000].text
    last = by["encode"]
    assert last.keys() == by["secrets"].keys() and all("token=abcdef" not in (r.text or "") for r in by["secrets"].values())
    back = {r.doc_id: r.text for r in pieces.decode(now, pieces.public_vocabulary()).collect()}
    assert all(back[i] == (r.text or "") for i, r in by["secrets"].items())


def test_stages_pass_empty_tables_nulls_and_clashing_names(spark, tmp_path):
    import corpus_pipeline as C

    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, __cut int, __base int, spans string, label int"
    rows = [(None, None, None, None, None, "a", 1, 1, "x", 1), (1, None, None, None, None, None, None, None, None, None), (1, "token=abcdef123456 " + "w " * 60, "en", "s", 5, "d", 2, 3, "y", 4), (2, "word " * 30_000, None, None, 3, None, None, None, None, None)]
    for name, table in (("none", []), ("some", rows)):
        spark.createDataFrame(table, schema).write.parquet(f"{d}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{d}/{name}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/{name}/benchmark.parquet")
        now = spark.read.parquet(f"{d}/{name}/documents.parquet")
        for step, stage in C.STAGES:
            now = kernels.kept(stage(spark, now, f"{d}/{name}"), step)
            assert now.count() == len(table), step
        if table:
            assert {r["__cut"] for r in now.collect()} == {1, 2, None} and {r.digest for r in now.collect()} == {"a", "d", None}
