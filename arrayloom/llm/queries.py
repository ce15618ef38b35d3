"""The queries of this package: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.llm import brown, byte_bpe, near, nearest, packing, passages, quality, token_files, toxicity, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), TOKENIZER, power=0.7)  # small sources count for more than they hold


def op2_coordinate_join_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_documents(spark, sf_dir), k=4, percent=80)


def op3_sentencepiece_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


def op4_warc_boundary_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_documents(spark, sf_dir))  # all holders of a seed; beyond the limits, see the README


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir))


def op7_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op8_brown_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(_documents(spark, sf_dir))


def op9_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (toxicity.fold() == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_range_coded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_digests(spark, token_files.written(_documents(spark, sf_dir), TOKENIZER))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixture_packing": op1_mixture_packing,
    "op2_coordinate_join_near_duplicates": op2_coordinate_join_near_duplicates,
    "op3_sentencepiece_byte_bpe": op3_sentencepiece_byte_bpe,
    "op4_warc_boundary_chains": op4_warc_boundary_chains,
    "op5_chained_passages": op5_chained_passages,
    "op6_compression_bands": op6_compression_bands,
    "op7_block_matrix_neighbours": op7_block_matrix_neighbours,
    "op8_brown_class_scores": op8_brown_class_scores,
    "op9_subword_toxicity": op9_subword_toxicity,
    "op10_range_coded_tokens": op10_range_coded_tokens,
}
#: For the others SQL has no counterpart (tokenizers, compression, trained models) or sums doubles in another order.
ORACLE_SQL: dict[str, str] = {
    "op2_coordinate_join_near_duplicates": r"""
        WITH RECURSIVE t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS x FROM w),
        n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON r.doc_id = e.a)
        SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(m) AS component_id, doc_id = min(m) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op4_warc_boundary_chains": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN strlen(html) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN strlen(html) >= 100 AND page_id <> first THEN first END AS refers_to FROM p""",
}
