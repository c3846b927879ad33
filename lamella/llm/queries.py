"""The text operators as registered queries, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import binary_ids, exact_dedup, media, mixing, near_dedup, packing, quality, sharding, token_counts, toxicity
from .common import documents, labels, scratch_path, tokenizer_path

SHARD_BYTES = 1 << 20
#: Target shares of the tokens of each labelled domain.
WEIGHTS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each encoded length that occurs: documents and tokens at it, up to it and from it on (suffix sums)."""
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in sequences of at most 4096; a row for each piece."""
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors over clean, low and toxic and a fitted rate for every document; converged says whether the targets are met."""
    docs = documents(spark, sf_dir)
    model = mixing.fit_classifier(docs, labels(spark, sf_dir), mixing.by_label(), list(WEIGHTS))
    rows = mixing.scored(model, docs, whole=False)
    return mixing.rates(mixing.fit_rates(model, rows, WEIGHTS), rows)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return near_dedup.near_classes(documents(spark, sf_dir)).drop("key")


def op5_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the chunk store, for every document."""
    return media.media(documents(spark, sf_dir), scratch_path(spark, "media"))


def op6_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets and checksums of every document's ids, read back from the segments."""
    path = scratch_path(spark, "ids")
    binary_ids.write_ids(documents(spark, sf_dir), path, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return binary_ids.read_ids(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, labels(spark, sf_dir)))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, by its id's hash."""
    return sharding.assign(documents(spark, sf_dir), SHARD_BYTES)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document; the largest doc_id stays."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="max")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_best_fit_packing, op3_source_mixing, op4_near_dedup, op5_media_chunks, op6_binary_ids, op7_toxicity, op8_quality, op9_sharding, op10_exact_dedup)}

ORACLE_SQL = {
    "op9_sharding": f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
     x AS (SELECT d.*, CAST(k.depth AS INTEGER) AS depth, h >> (60 - CAST(k.depth AS INTEGER)) AS node FROM d, range(0, 41) AS k(depth)),
     s AS (SELECT *, sum(n_bytes) OVER w AS b, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY depth, node)),
     f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS r FROM s WHERE b <= {SHARD_BYTES} OR n = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '-' ELSE lpad(bin(node), depth, '0') END AS shard, depth,
       CAST(b AS BIGINT) AS shard_bytes, n AS shard_docs, b > {SHARD_BYTES} AS oversized
FROM f WHERE r = 1""",
    "op10_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}
