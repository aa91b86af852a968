"""The registered queries of this subpackage, and their check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import check_sql, fingerprints, hilbert, lexical, licenses, mixing, nearcopies, packing, perplexity, prefixtrie, quality, revisits, suffixes, vectors

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_duplicates(table(spark, sf_dir, "documents"))


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("host_rate", "host_limit")})


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.assign(table(spark, sf_dir, "documents"))
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed_spans(table(spark, sf_dir, "documents"))


def op5_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    trusted = labels.where("quality = 1 AND toxic = 0").select("doc_id")
    return perplexity.classify(table(spark, sf_dir, "documents"), trusted)


def op7_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = revisits.capture_records(table(spark, sf_dir, "pages"))
    return revisits.digest(revisits.resolve(records))


def op9_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op10_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_host_rules": op2_host_rules,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_product_quantisation": op5_product_quantisation,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_budget_mix": op7_budget_mix,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_license_automaton": op9_license_automaton,
    "op10_sum_of_squares": op10_sum_of_squares,
    "op11_block_max": op11_block_max,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_one_permutation": op13_one_permutation,
}
SQL: dict[str, str] = {
    "op2_host_rules": check_sql.HOST_RULES,
    "op4_suffix_dedup": check_sql.REPEATED_BYTES,
    "op5_product_quantisation": check_sql.VECTOR_LINKS,
    "op8_warc_revisits": check_sql.REVISITS,
    "op11_block_max": check_sql.RANKED,
    "op12_prefix_trie": check_sql.TRIE,
}
