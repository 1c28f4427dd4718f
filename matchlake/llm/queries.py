"""The queries of the corpus operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import manifest, pii, secrets, toxicity
from matchlake.llm.decontamination import find_leaks
from matchlake.llm.extraction import extract_pages
from matchlake.llm.fill_in_middle import fill_in_middle, restored
from matchlake.llm.language_model import language_scores
from matchlake.llm.ngram_join import similar_sets
from matchlake.llm.oracles import ORACLES
from matchlake.llm.packing import pack_documents
from matchlake.llm.quality import quality_rules
from matchlake.llm.sharding import shard_by_bytes
from matchlake.llm.token_counts import count_tokens


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_nonnegative_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_table(spark, sf_dir, "documents"), shards=24)


def op3_set_relation_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op4_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op5_grouping_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k", capacity=1024)


def op6_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), F.round("similarity", 6).alias("similarity"), "start", "length")


def op7_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def _listed(spans: str, base_only: bool = False):
    """kind:start:end of the spans, comma-joined in their order."""
    kept = F.filter(spans, lambda s: s["base"]) if base_only else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _counted(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def op8_hierarchical_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(_table(spark, sf_dir, "documents"))


def op9_ownership_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"), owner="source")
    return found.select("doc_id", *[_counted("spans", k) for k in secrets.BASE_KINDS], "base_sha256", _listed("spans").alias("spans"),
                        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
                        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"))


def op10_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), *[_counted("spans", k) for k in pii.BASE], F.sha2(_listed("spans", base_only=True), 256).alias("base_sha256"),
                        _listed("spans").alias("spans"))


def op11_split_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents"), seed=1, plain_percent=10, spm_percent=20)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_proof_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's leaf is checked as it would be told, some with one character more than there is."""
    told = F.col("n_chars") + (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 0).cast("int")
    claimed = manifest.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), told, F.col("text"))
    rows = manifest.merkle_manifest(_table(spark, sf_dir, "documents"), claimed=claimed)
    rows = rows.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), manifest.folded(F.col("claimed"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_whole_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), vocabulary="byte_bpe_50k.json", limit=512)


QUERIES = {
    "op1_nonnegative_pu": op1_nonnegative_pu,
    "op2_sampled_splitters": op2_sampled_splitters,
    "op3_set_relation_skipping": op3_set_relation_skipping,
    "op4_minimum_cut": op4_minimum_cut,
    "op5_grouping_genetic": op5_grouping_genetic,
    "op6_simhash_windows": op6_simhash_windows,
    "op7_distribution_divergence": op7_distribution_divergence,
    "op8_hierarchical_pitman_yor": op8_hierarchical_pitman_yor,
    "op9_ownership_frequency": op9_ownership_frequency,
    "op10_candidate_boosting": op10_candidate_boosting,
    "op11_split_offsets": op11_split_offsets,
    "op12_proof_push": op12_proof_push,
    "op13_whole_tokens": op13_whole_tokens,
}

__all__ = ["ORACLES", "QUERIES"]
