"""Corpus preparation in stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice.llm import decontaminate as benchmark_items
from simlattice.llm import line_dedup, near_dedup, packing, quality
from simlattice.llm.shared import new_path, row_key, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learned from labels outside fold 0 of 5, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.fold(5) != 0)
    return quality.score(docs, model, "_quality").filter("_quality >= 0.3").drop("_quality")


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share stay only where they come first; documents of which nothing is left go."""
    columns = docs.columns
    out = line_dedup.dedup_lines(docs, min_docs=10, keep="first", min_chars=1)
    blank = F.trim(F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", " ")) == ""
    out = out.filter((F.col("n_dropped") == 0) | ~blank).withColumn("text", F.col("kept_text"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their sets of five words, the one with the smallest id."""
    groups = near_dedup.near_duplicates(docs, shingle=5, percent=80, keys=True)
    gone = groups.filter("not kept").select(F.col("rk").alias("_rk")).distinct()
    return docs.withColumn("_rk", row_key()).join(gone, "_rk", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    out = benchmark_items.find_items(docs, table(spark, sf_dir, "benchmark"))
    return out.filter(benchmark_items.is_clean()).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of at most 2048 ids goes."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", without_common_lines),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL cannot say the classifier or the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
