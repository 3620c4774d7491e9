"""What the media store writes is compressed with zstd."""

import glob

import pyarrow.parquet as pq

from tidewire.llm import media


def test_rows_are_compressed(spark, tmp_path):
    path = str(tmp_path / "media")
    media.write(spark.createDataFrame([(k, f"text {k % 3} " * 300) for k in range(9)], "doc_id long, text string"), path)
    files = glob.glob(f"{path}/rows/*.parquet") + glob.glob(f"{path}/media/*.parquet")
    codecs = {m.row_group(g).column(0).compression for m in (pq.ParquetFile(f).metadata for f in files) for g in range(m.num_row_groups)}
    assert codecs == {"ZSTD"} and media.read(spark, path).count() == 9


def test_lists_of_chunks_are_kept_once(spark, tmp_path, monkeypatch):
    from tidewire.llm import kernels as K

    kept, before = [], K.kept

    def seen(frame, name, *codec):
        kept.append((name, frame.columns))
        return before(frame, name, *codec)

    monkeypatch.setattr(K, "kept", seen)
    path = str(tmp_path / "media")
    texts = [None, "", "one " * 900, "one " * 900, "one " * 900 + "two " * 900, " ".join(map(str, range(4000))), "x" + " ".join(map(str, range(4000)))]
    media.write(spark.createDataFrame([(k % 6, t) for k, t in enumerate(texts)], "doc_id long, text string"), path)
    assert kept == [("lists", ["doc_id", "n_bytes", "media_id", "digests"])]
    got = media.read(spark, path).collect()
    assert len(got) == 7 and sorted(r.n_bytes for r in got) == sorted(len(t or "") for t in texts)
    stored = spark.read.parquet(f"{path}/media").collect()
    owned = [c.digest for r in stored for c in r.chunks if c.owned]
    assert len(stored) == 5 and len(owned) == len(set(owned)) and {c.digest for r in stored for c in r.chunks} == set(owned)
    listed = [c.digest for r in stored for c in r.chunks]
    assert all(c.shared == (listed.count(c.digest) > 1) for r in stored for c in r.chunks)
