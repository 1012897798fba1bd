"""Mapping of the driver's TPC-H-like tables onto the series roles.

Fixed choices (mirrored by the DuckDB oracle SQL in ``__spark_entry__``):

* entity   = ``l_suppkey`` (dimension ``supplier``; title ``s_name``;
             category ``n_name`` via ``s_nationkey``)
* period   = ``year(l_shipdate) - 1994`` (ordinal 1..7 for 1995..2001)
* item     = ``l_orderkey || '-' || l_linenumber`` (NOT unique: duplicates
             exercise the duplicate checks and first-wins de-duplication)
* ordinal  = ``l_linenumber``
* score    = ``1 + 90 * l_discount`` (discount 0..0.10 -> score 1..10, the
             reference's score scale)
* weight   = ``cast(l_quantity as bigint)``

Cleaning inputs (raw dumps analogue, before any rule is applied):

* raw items    = every lineitem row; period text = ``year - 1995`` with 2001
                 missing (1995 becomes the special period 0, 2001 NULL)
* raw ratings  = (item id, score, weight) of every lineitem row (ids repeat)
* raw types    = the item's part type (``p_type``) via ``l_partkey``; valid
                 types exclude ``PROMO``
* selected     = suppliers outside the ``MIDDLE EAST`` region
* entity basics= supplier rows (title, first/last shipping year, nation and
                 region as a comma-joined multi-value attribute)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joins import attach
from tidemark.schemas import SeriesCols

# Fixed values of the mapping.
FIRST_YEAR = 1994
CLEAN_FIRST_YEAR = 1995
CLEAN_MISSING_YEAR = 2001
INVALID_TYPES = ("PROMO",)
VALID_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD")
EXCLUDED_REGIONS = ("MIDDLE EAST",)
ID_PREFIX = "1"  # what the prefix check looks for: a part of the order numbers
ITEM_LINK_PREFIX = "https://example.org/item/"

COLS = SeriesCols()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` (a new reader each time, so a rewritten table is seen)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def item_id_expr() -> F.Column:
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))


def score_expr() -> F.Column:
    return F.lit(1.0) + F.lit(90.0) * F.col("l_discount")


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed item fact: (item_id, entity_id, period, ordinal, score, weight)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        item_id_expr().alias(COLS.item),
        F.col("l_suppkey").alias(COLS.entity),
        (F.year("l_shipdate") - F.lit(FIRST_YEAR)).cast("int").alias(COLS.period),
        F.col("l_linenumber").alias(COLS.ordinal),
        score_expr().alias(COLS.score),
        F.col("l_quantity").cast("bigint").alias(COLS.weight),
    )


def daily_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few entities with very long series: entity = return flag, period = day, score = discount in percent."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        item_id_expr().alias(COLS.item),
        F.col("l_returnflag").alias(COLS.entity),
        F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).alias(COLS.period),
        F.col("l_linenumber").alias(COLS.ordinal),
        F.round(F.col("l_discount") * F.lit(100.0)).alias(COLS.score),
        F.col("l_quantity").cast("bigint").alias(COLS.weight),
    )


def entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier rows with nation/region names (small dimension)."""
    s = table(spark, sf_dir, "supplier")
    # nation (25 rows) and region (5 rows) have a fixed size at every scale factor
    n = F.broadcast(table(spark, sf_dir, "nation"))
    r = F.broadcast(table(spark, sf_dir, "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey, "left")
        .join(r, F.col("n_regionkey") == r.r_regionkey, "left")
        .select(
            F.col("s_suppkey").alias(COLS.entity),
            F.col("s_name").alias("title"),
            F.col("n_name").alias("category"),
            F.col("r_name").alias("region"),
        )
    )


def dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity dimension for the marts: (entity_id, title, category, genres)."""
    return entity_rows(spark, sf_dir).select(
        COLS.entity, "title", "category", F.concat_ws(",", "category", "region").alias("genres")
    )


def shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity list with titles: (entity_id, title)."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias(COLS.entity), F.col("s_name").alias("title"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-maintained category table analogue: (entity_id, title, category)."""
    s = table(spark, sf_dir, "supplier")
    n = F.broadcast(table(spark, sf_dir, "nation"))  # fixed size: 25 rows at every scale factor
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
        F.col("s_suppkey").alias(COLS.entity), F.col("s_name").alias("title"), F.col("n_name").alias("category")
    )


def entity_rows_bound(spark: SparkSession, sf_dir: str) -> int:
    """Row count of the supplier table: a proven upper bound for every frame
    that filters or projects it (selected entities, titles). A plain scan
    count reads only Parquet footers."""
    return table(spark, sf_dir, "supplier").count()


def selected_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        entity_rows(spark, sf_dir)
        .filter(~F.col("region").isin(*EXCLUDED_REGIONS))
        .select(COLS.entity)
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw item rows as text, like a header-driven all-string dump."""
    li = table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate")
    period = F.when(year == F.lit(CLEAN_MISSING_YEAR), F.lit(None)).otherwise(year - F.lit(CLEAN_FIRST_YEAR))
    return li.select(
        item_id_expr().alias("item_id"),
        F.col("l_suppkey").cast("string").alias("parent_id"),
        period.cast("string").alias("period_text"),
        F.col("l_linenumber").cast("string").alias("ordinal_text"),
    )


def raw_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, score, weight) for every lineitem row: an id can have several
    rating rows, and every one of them joins its items."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        item_id_expr().alias("item_id"),
        score_expr().alias("score"),
        F.col("l_quantity").cast("bigint").alias("weight"),
    )


def raw_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, item_type): the item's part type, possibly several rows per id."""
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    # the part table is broadcast only under its counted size (a footer-only count)
    joined = attach(li, p, ["l_partkey"], "inner", table_rows=table(spark, sf_dir, "part").count())
    return joined.select(item_id_expr().alias("item_id"), F.col("p_type").alias("item_type"))


def entity_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity metadata rows: (entity_id, title, start_year, end_year, genres)."""
    li = table(spark, sf_dir, "lineitem")
    years = li.groupBy(F.col("l_suppkey").alias(COLS.entity)).agg(
        F.min(F.year("l_shipdate")).alias("start_year"), F.max(F.year("l_shipdate")).alias("end_year")
    )
    return (
        entity_rows(spark, sf_dir)
        .join(years, COLS.entity, "left")
        .select(
            F.col(COLS.entity).cast("string").alias(COLS.entity),
            "title",
            "start_year",
            "end_year",
            F.concat_ws(",", "category", "region").alias("genres"),
        )
    )
