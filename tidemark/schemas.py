"""Column roles and explicit schemas.

The operators are domain-neutral: an *entity* (long-lived parent) has
*items* (atomic fact rows) bucketed into ordered integer *periods*; each
item carries a *score* and a non-negative *weight*. ``SeriesCols`` names
the columns that play those roles so the same code runs on any table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class SeriesCols:
    entity: str = "entity_id"
    period: str = "period"
    item: str = "item_id"
    ordinal: str = "ordinal"
    score: str = "score"
    weight: str = "weight"


def all_strings(*names: str) -> T.StructType:
    """Raw text inputs are read as all-string and cast later."""
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


# Raw dump layouts (header names of the tab-separated inputs; fixed values).
RAW_ITEM_SCHEMA = all_strings("tconst", "parentTconst", "seasonNumber", "episodeNumber")
RAW_RATING_SCHEMA = all_strings("tconst", "averageRating", "numVotes")
RAW_BASICS_SCHEMA = all_strings(
    "tconst", "titleType", "primaryTitle", "startYear", "endYear", "runtimeMinutes", "genres"
)

# Typed fact / dimension layouts used when reading cleaned CSV outputs.
FACT_SCHEMA = T.StructType(
    [
        T.StructField("item_id", T.StringType(), True),
        T.StructField("entity_id", T.StringType(), True),
        T.StructField("period", T.IntegerType(), True),
        T.StructField("ordinal", T.IntegerType(), True),
        T.StructField("score", T.DoubleType(), True),
        T.StructField("weight", T.LongType(), True),
    ]
)
CATEGORY_SCHEMA = all_strings("entity_id", "title", "category")
