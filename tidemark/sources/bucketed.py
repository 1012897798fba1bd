"""Tables written for joins that need no exchange.

``write_bucketed`` hashes a table into buckets by one key, sorted inside; ``like`` gives it the number of
buckets of the table that it will meet (else the smaller one is exchanged). The keys that hold
a large share of the rows are counted by a sketch while the table is written; a bucket can't be divided, so
``colocated_join`` joins those few keys over a grid of parts and all others bucket by bucket.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.skew import MIN_PART_ROWS, Split, heavy_hitters, salts, split_join
from tidemark.session import materialize_observed, stage_folder

ROWS_PER_BUCKET = 2_000_000


@dataclass(frozen=True)
class Bucketed:
    """A bucketed table of the session's catalog; ``hot`` maps its frequent keys to parts."""

    name: str
    key: str
    buckets: int
    hot: dict

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)


def write_bucketed(df: DataFrame, key: str, name: str | None = None, path: str | None = None, like: Bucketed | None = None,
                   rows_per_bucket: int = ROWS_PER_BUCKET, min_part_rows: int = MIN_PART_ROWS) -> Bucketed:
    """Write ``df`` bucketed by ``key`` (as stage table, or under ``path`` as ``name``). Rows are written once
    as they come and counted on the way, then dealt into buckets: one file a bucket."""
    spark = df.sparkSession
    stored, seen = materialize_observed(df, hot=heavy_hitters(F.col(key)))
    buckets = like.buckets if like else max(1, -(-seen["rows"] // rows_per_bucket))
    name = name or f"tidemark_{uuid.uuid4().hex}"
    stored.repartition(buckets, F.col(key)).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option(
        "path", path or f"{stage_folder(spark)}/{name}").saveAsTable(name)
    return Bucketed(name, key, buckets, salts(seen["hot"], seen["rows"], min_part_rows))


def colocated_join(spark: SparkSession, left: Bucketed, right: Bucketed) -> DataFrame:
    """Inner join of two tables bucketed by the same key: no exchange but of the rows of hot keys."""
    if left.key != right.key:
        raise ValueError(f"bucketed by {left.key} and {right.key}")
    key, a, b = left.key, left.read(spark), right.read(spark)
    hot = sorted(set(left.hot) | set(right.hot))  # at most twice skew.HOT_SHARES keys
    if not hot:
        return a.join(b, key)
    cold = ~F.col(key).isin(hot)
    split = split_join(a.filter(F.col(key).isin(hot)), b.filter(F.col(key).isin(hot)), key, Split(left.hot, right.hot))
    return a.filter(cold).join(b.filter(cold), key).unionByName(split)
