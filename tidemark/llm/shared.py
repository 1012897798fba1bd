"""Helpers shared by the operators: stage tables in the cluster's shared folder,
skew-safe lookups and Arrow batch access."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import stage_folder

HOT_PARTS = 256  # a key is hot when it holds more than 1/HOT_PARTS of the rows


def ship_package(spark: SparkSession) -> None:
    """Let the executors' Python import this package, once per application (Spark
    serves the archive from the driver, so no folder needs to be shared)."""
    sc = spark.sparkContext
    if getattr(sc, "_lm_shipped", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lm-package-"), f"{root.name}_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._lm_shipped = sc.applicationId


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the application's folder in ``spark.checkpoint.dir``."""
    return f"{stage_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back (lineage cut that
    survives the loss of any executor)."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(big: DataFrame, small: DataFrame, key: str, n_col: str, total: int, row_hash: Column) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row per ``key``, ``n_col`` = the rows of
    ``big`` with that key), with hot keys dealt over many tasks.

    At most ``HOT_PARTS`` keys can hold more than ``total / HOT_PARTS`` rows, so the
    hot list that is broadcast is bounded by construction. Their rows get a salt
    from ``row_hash``, their ``small`` row is repeated once per salt.
    """
    hot = small.where(F.col(n_col) * HOT_PARTS > F.lit(total)).select(
        F.col(key).alias("_lm_hot_key"),
        F.ceil(F.col(n_col) * HOT_PARTS / F.lit(max(total, 1))).cast("int").alias("_lm_salts"),
    )
    salts = F.coalesce(F.col("_lm_salts"), F.lit(1))
    left = (
        big.join(F.broadcast(hot), F.col(key) == F.col("_lm_hot_key"), "left")
        .withColumn("_lm_salt", F.pmod(row_hash, salts).cast("int"))
        .drop("_lm_hot_key", "_lm_salts")
    )
    copies = F.ceil(F.col(n_col) * HOT_PARTS / F.lit(max(total, 1))).cast("int")
    right = small.withColumn(
        "_lm_salt",
        F.explode(F.sequence(F.lit(0), F.when(F.col(n_col) * HOT_PARTS > F.lit(total), copies - 1).otherwise(F.lit(0)))),
    )
    return left.join(right, [key, "_lm_salt"]).drop("_lm_salt")


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (no nulls) and its row offsets (n + 1)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about ``max_bytes`` of text each (a longer row stays alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offs = string_buffer(batch.column(column % batch.num_columns))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offs, offs[first] + max_bytes, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
