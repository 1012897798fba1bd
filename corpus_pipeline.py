"""A training-data pipeline over ``documents``: quality, near-duplicates, benchmark
leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and reads it back as the next stage's docs, so a
lost executor repeats at most one stage. All stages but the last return the
columns of ``documents``. Rows with a NULL doc_id or text pass every stage by the
rules of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, minhash, packing, pii, quality
from tidemark.llm.registry import QUALITY_CUT, TOKENIZER, table, train_quality
from tidemark.llm.shared import free_name, ship_package, stage, text_or_empty


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker predicts good, by the decision of op9; with labels
    of one class the score is that class's constant, so all stay or all go."""
    ship_package(spark)
    ranker = train_quality(spark, docs, sf_dir)
    score = free_name(docs, "_lm_score")
    return quality.add_score(docs, ranker, score).where(F.col(score) >= QUALITY_CUT).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of every group of near-duplicates; rows that repeat an id
    are one group, too: of its texts the one of the smallest hash stays, in every run."""
    ship_package(spark)
    name = free_name(docs, "_lm_kept")
    kept = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    chosen = docs.join(kept, F.col("doc_id") == F.col(name)).drop(name)
    one = chosen.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns))).alias(name))
    return one.select(f"{name}.*").unionAll(docs.where("doc_id IS NULL"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark item."""
    ship_package(spark)
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind (n_chars follows the text)."""
    ship_package(spark)
    name = free_name(docs, "_lm_found")
    found = docs.withColumn(name, pii.span_finder(spark, pii.train(docs))(text_or_empty("text")))
    changed = F.size(F.col(name)["spans"]) > 0
    masked = F.col(name)["masked"]
    return found.withColumns({
        "text": F.when(changed, masked).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.char_length(masked).cast("long")).otherwise(F.col("n_chars")),
    }).drop(name)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces packed into sequences."""
    ship_package(spark)
    pieces = packing.token_pieces(docs, TOKENIZER, keep_ids=False)
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("best-fit packing", packed),
]

# Learned scores, edit distances and packing are not expressible in SQL; tests/llm compares
# each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{i}")
    return docs
