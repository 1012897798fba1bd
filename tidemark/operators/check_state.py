"""Data-quality checks over batches without reading earlier batches again.

Everything that Q1-Q11 ask is a sum: counts over rows, and per key the number of rows in each table
(repeated ids, ids without a type, unknown entities are questions about those numbers). A batch is
therefore reduced once to its counts and its keys' row numbers, written as one versioned table (a batch
counts once it is whole, and a repeated batch replaces itself). ``merged_checks`` adds up the states
of all batches; only keys and numbers are read and exchanged, never the items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.operators.quality import ENTITY_TAGS, QualityRules
from tidemark.sources.versions import subfolders, versions, write_version

_ITEM, _ENTITY, _MEASURE = "item", "entity", "measure"
_ITEM_TAGS = ["i", "t"]


def batch_state(items: DataFrame, metadata: DataFrame, types: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """(kind, key, i, t, e, m, counts): one row of counts and a row for each item id and entity id."""
    def keyed(tagged: DataFrame, key: str, kind: str) -> DataFrame:
        summed = tagged.withColumn("key", F.col(key).cast("string")).drop(key).groupBy("key").agg(
            *[F.sum(t).alias(t) for t in tagged.columns if t != key])
        return summed.withColumn("kind", F.lit(kind))

    parts = [
        keyed(quality.item_key_tags(items, types), "item_id", _ITEM),
        keyed(quality.entity_key_tags(items, metadata), "entity_id", _ENTITY),
        quality.item_measures(items, metadata, types, rules).withColumn("kind", F.lit(_MEASURE)),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def add_batch(path: str, batch: str, items: DataFrame, metadata: DataFrame, types: DataFrame,
              rules: QualityRules = QualityRules()) -> None:
    """Write the state of a batch; the same batch name again replaces it (a retry, a correction)."""
    write_version(batch_state(items, metadata, types, rules), f"{path.rstrip('/')}/{batch}", keep=1)


def merged_checks(spark: SparkSession, path: str, expected: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Q1-Q11 over all complete batches under ``path``: the rows of ``quality.item_checks`` on their union."""
    batches = [versions(spark, folder) for folder in subfolders(spark, path)]
    folders = [complete[-1] for complete in batches if complete]
    if not folders:
        raise FileNotFoundError(f"{path}: no complete batch")
    # merged by name: a batch written under other rules may lack a count, which then adds nothing
    state = spark.read.option("mergeSchema", True).parquet(*folders)
    counts = [c for c in state.columns if c not in {"kind", "key", *_ITEM_TAGS, *ENTITY_TAGS}]
    measures = state.filter(F.col("kind") == _MEASURE).agg(*[F.sum(c).alias(c) for c in counts])

    def keys(kind: str, name: str, tags: list[str]) -> DataFrame:
        return state.filter(F.col("kind") == kind).select(F.col("key").alias(name), *tags)

    return quality.item_results(measures, keys(_ITEM, "item_id", _ITEM_TAGS), keys(_ENTITY, "entity_id", ENTITY_TAGS),
                                expected.select(F.col("entity_id").cast("string").alias("entity_id")), rules)
