"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import fill_middle, merkle, sharding
from tidewire.llm.decontaminate import op3_suffix_automaton
from tidewire.llm.html_text import op4_nearest_url
from tidewire.llm.huffman import op6_huffman_ids
from tidewire.llm.language_model import op2_deleted_interpolation
from tidewire.llm.media import op5_gear_chunks
from tidewire.llm.near_dedup import op9_probminhash
from tidewire.llm.passages import op1_compact_windows
from tidewire.llm.pieces import op10_unigram_pieces
from tidewire.llm.secrets import op8_credential_links
from tidewire.llm.toxicity import op7_string_kernel


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compact_windows": op1_compact_windows,
    "op2_deleted_interpolation": op2_deleted_interpolation,
    "op3_suffix_automaton": op3_suffix_automaton,
    "op4_nearest_url": op4_nearest_url,
    "op5_gear_chunks": op5_gear_chunks,
    "op6_huffman_ids": op6_huffman_ids,
    "op7_string_kernel": op7_string_kernel,
    "op8_credential_links": op8_credential_links,
    "op9_probminhash": op9_probminhash,
    "op10_unigram_pieces": op10_unigram_pieces,
    "op11_lookaround_split": fill_middle.op11_lookaround_split,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_histogram_sort": sharding.op13_histogram_sort,
    "pipeline": _pipeline,
}
_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: Windows as word sequences that documents and items share; learned, iterative and encoding operators have no SQL.
ORACLE_SQL: dict[str, str] = {
    "op3_suffix_automaton": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS pos FROM i WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(w[pos : pos + n - 1], ' ') AS g FROM s),
p AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM wins)),
hits AS (SELECT g.r, g.pos, g.n, wins.item FROM (SELECT r, pos, n, array_to_string(w[pos : pos + n - 1], ' ') AS g FROM p) g JOIN wins USING (n, g)),
words AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS word FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op11_lookaround_split": fill_middle.SQL,
    "op12_merkle_manifest": merkle.SQL,
}
