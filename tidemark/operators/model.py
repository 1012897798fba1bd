"""Star schema (M1 dim_entity, M2 fact_item; P7, J7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import MAX_BROADCAST_ROWS, attach

DIM_COLUMNS = ["entity_id", "title", "start_year", "end_year", "genres", "category"]
FACT_COLUMNS = ["item_id", "entity_id", "period", "ordinal", "score", "weight"]


def _year(col: str) -> F.Column:
    # Year text such as '2008' or '2008.0' -> 2008; junk -> NULL (ANSI-safe).
    return F.col(col).cast("string").try_cast("double").cast("int")


def dim_entity(metadata: DataFrame, category: DataFrame, category_rows: int | None = None,
               max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """M1: metadata LEFT JOIN category; NULL category when unmatched; duplicate
    category keys fan out (as a SQL join does)."""
    cat = category.select(F.col("entity_id").cast("string").alias("entity_id"), "category")
    meta = metadata.withColumn("entity_id", F.col("entity_id").cast("string"))
    joined = attach(meta, cat, ["entity_id"], "left", table_rows=category_rows,
                    max_broadcast_rows=max_broadcast_rows)
    return joined.select(
        "entity_id",
        "title",
        _year("start_year").alias("start_year"),
        _year("end_year").alias("end_year"),
        "genres",
        "category",
    )


def fact_item(items: DataFrame) -> DataFrame:
    """M2: typed projection, no filter, no de-duplication."""
    return items.select(
        F.col("item_id").cast("string").alias("item_id"),
        F.col("entity_id"),
        F.col("period").cast("int").alias("period"),
        F.col("ordinal").cast("int").alias("ordinal"),
        F.col("score").cast("double").alias("score"),
        F.col("weight").cast("bigint").alias("weight"),
    )
