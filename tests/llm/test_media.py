import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewire.llm import media as M


def made():
    rng = random.Random(2)
    big = "".join(rng.choice("abcdefgh \n") for _ in range(60_000))
    return [None, "", "é", "x" * 575, "x" * 576, "x" * 577, "a" * 90_000, big, big[:30_000], "new start " + big, big + " end", big[:20_000] + "change" + big[20_000:], big, "é" * 3000]


def test_hash_is_the_rolling_one():
    data = np.frombuffer(random.Random(1).randbytes(500), np.uint8)
    h, want = 0, []
    for b in data:
        h = (h << 1) + int(M.GEAR[b]) & 0xFFFFFFFF
        want.append(h)
    assert M.gear_hashes(data).tolist() == want
    assert M.gear_hashes(data[:3]).tolist() == want[:3] and len(M.gear_hashes(data[:0])) == 0


def test_cuts_depend_on_the_payload_alone():
    texts = made()
    data, offsets, _ = M.payloads(pa.array(texts, pa.string()))
    together = M.cuts(data, offsets)
    for k, t in enumerate(texts):
        own, o, _ = M.payloads(pa.array([t], pa.string()))
        assert [e - offsets[k] for e in together[k]] == M.cuts(own, o)[0]
        sizes = np.diff([0, *M.cuts(own, o)[0]])
        assert sizes.max() <= M.MOST and (sizes[:-1] >= M.LEAST).all()


def test_read_back(spark, tmp_path):
    texts = made()
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(3, texts[3], "c"), (None, texts[7], "c")]
    path = str(tmp_path / "m")
    M.write(spark.createDataFrame(rows, "doc_id long, text string, media_id string").repartition(3), path)
    got = M.read(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (texts[7 if r.doc_id is None else r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    media = spark.read.parquet(f"{path}/media").collect()
    stored = {M.stored_form([c.asDict() for c in m.chunks], bytes(m.blob)) for m in media}
    assert {(r.media_bytes, r.media_sha256) for r in got} == {(len(x), hashlib.sha256(x).hexdigest()) for x in stored}
    assert sum(map(len, stored)) < sum({r.payload_sha256: r.payload_bytes for r in got}.values())
    names = [c.digest for m in media for c in m.chunks if c.owned]
    assert len(names) == len(set(names)) and any(not c.owned for m in media for c in m.chunks)
    same = [r for r in got if r.doc_id in (7, 12, None)]
    assert len({(r.media_sha256, r.feature) for r in same}) == 1


def test_damage_is_noticed_and_empty_tables_pass(spark, tmp_path):
    path = str(tmp_path / "m")
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    M.write(docs.where("false"), path)
    assert M.read(spark, path).count() == 0
    other = str(tmp_path / "n")
    M.write(docs, other)
    rows = spark.read.parquet(f"{other}/media")
    from pyspark.sql import functions as F

    bad = rows.withColumn("chunks", F.transform("chunks", lambda c: c.withField("digest", F.unhex(F.lit("00")))))
    bad.write.parquet(f"{tmp_path}/o/media")
    spark.read.parquet(f"{other}/rows").write.parquet(f"{tmp_path}/o/rows")
    with pytest.raises(Exception, match="isn't the one"):
        M.read(spark, f"{tmp_path}/o").collect()
