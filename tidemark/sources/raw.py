"""Readers for the raw tab-separated dumps and the cleaned CSV files.

* Raw dumps are header-driven and read as all-string (no ``inferSchema``);
  only ``\\N`` (and an empty field) means NULL, quoting is off so quotes in
  titles are kept. gzip dumps go through ``sources.gzip_dump``, which splits
  them by members and keeps malformed lines apart (``malformed_lines``).
* Column names are mapped to the operator layouts right after the read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import CATEGORY_SCHEMA, RAW_BASICS_SCHEMA, RAW_ITEM_SCHEMA, RAW_RATING_SCHEMA
from tidemark.sources.gzip_dump import MALFORMED, read_gzip_dump

# Raw dump column names -> operator layouts (fixed values).
ITEM_RENAMES = {"tconst": "item_id", "parentTconst": "parent_id", "seasonNumber": "period_text",
                "episodeNumber": "ordinal_text"}
RATING_RENAMES = {"tconst": "item_id", "averageRating": "score", "numVotes": "weight"}
BASICS_RENAMES = {"tconst": "item_id", "titleType": "item_type", "primaryTitle": "title",
                  "startYear": "start_year", "endYear": "end_year"}
NULL_TOKEN = "\\N"


def read_dump(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A tab-separated dump with a header; all strings unless ``schema``."""
    if path.endswith(".gz"):
        rows = read_gzip_dump(spark, path).filter(F.col(MALFORMED).isNull()).drop(MALFORMED)
        return rows if schema is None else rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    reader = (
        spark.read.option("header", True)
        .option("sep", "\t")
        .option("nullValue", NULL_TOKEN)
        .option("quote", "")
        .option("mode", "PERMISSIVE")
    )
    if schema is not None:  # a header that says otherwise is an error
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a gzip dump whose number of fields isn't the header's: (line)."""
    return read_gzip_dump(spark, path).filter(F.col(MALFORMED).isNotNull()).select(F.col(MALFORMED).alias("line"))


def raw_items(spark: SparkSession, path: str) -> DataFrame:
    return read_dump(spark, path, RAW_ITEM_SCHEMA).withColumnsRenamed(ITEM_RENAMES).select(*ITEM_RENAMES.values())


def raw_ratings(spark: SparkSession, path: str) -> DataFrame:
    df = read_dump(spark, path, RAW_RATING_SCHEMA).withColumnsRenamed(RATING_RENAMES)
    return df.select(
        "item_id",
        F.col("score").try_cast("double").alias("score"),
        F.col("weight").try_cast("bigint").alias("weight"),
    )


def raw_basics(spark: SparkSession, path: str) -> DataFrame:
    """Item and entity rows together: (item_id, item_type, title, start_year, end_year, genres)."""
    return read_dump(spark, path, RAW_BASICS_SCHEMA).withColumnsRenamed(BASICS_RENAMES).select(
        "item_id", "item_type", "title", "start_year", "end_year", "genres"
    )


def entity_basics(basics: DataFrame) -> DataFrame:
    """The entity-level rows of the basics dump, in the metadata layout."""
    return basics.select(F.col("item_id").alias("entity_id"), "title", "start_year", "end_year", "genres")


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A cleaned CSV with a header, explicit schema (never inferred)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """Hand-maintained (entity_id, title, category) table."""
    return read_csv_table(spark, path, CATEGORY_SCHEMA)
