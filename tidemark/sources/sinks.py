"""Sinks and gates.

Outputs are written with ``mode("overwrite")`` (replace-and-create). Parquet
is the default between stages; CSV with a header only at the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sort_by: list[str] | None = None) -> None:
    """Replace the output at ``path``. ``sort_by`` orders the rows for a
    presentation file (a range-partitioned sort, no single-task sort)."""
    out = df.orderBy(*sort_by) if sort_by else df
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Replace-and-create a temporary view."""
    df.createOrReplaceTempView(name)
    return df


def input_gate(df: DataFrame, name: str, required: list[str]) -> DataFrame:
    """One row (input, missing_columns, row_count, ok). Missing columns
    come from the schema (no job); the row count is one aggregate."""
    missing = sorted(set(required) - set(df.columns))
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("input"),
        F.lit(",".join(missing)).alias("missing_columns"),
        "row_count",
        ((F.col("row_count") > 0) & F.lit(not missing)).alias("ok"),
    )


# Presentation order of the exported files (fixed values, O1/O2).
EXPORT_ORDER = {
    "clean_items": ["entity_id", "period", "ordinal", "item_id"],
    "entity_metadata": ["entity_id"],
    "item_types": ["item_id"],
    "dim_entity": ["entity_id"],
    "period_kpis": ["entity_id", "period"],
    "break_period": ["entity_id"],
    "durability": ["entity_id"],
    "entity_summary": ["entity_id"],
    "reconcile_counts": ["entity_id", "period"],
    "duplicate_keys": ["item_id"],
    "break_sanity": ["entity_id"],
}


def export_csv(tables: dict[str, DataFrame], out_dir: str) -> None:
    """S9 + O1: write each table as a header CSV folder under ``out_dir``, rows in
    presentation order (a range-partitioned sort, no single-task sort)."""
    for name, df in tables.items():
        keys = [k for k in EXPORT_ORDER.get(name, []) if k in df.columns]
        write_table(df, f"{out_dir.rstrip('/')}/{name}", fmt="csv", sort_by=keys or None)
