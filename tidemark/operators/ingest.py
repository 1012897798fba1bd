"""Ingest and clean.

One lazy plan gives every raw item row a ``reject_reason`` (NULL = kept);
``clean_items`` keeps the NULL rows, ``clean_funnel`` counts the rest per
reason. No per-step ``count()`` and no driver-side key sets.

Raw input layouts (rename dump columns with ``sources.raw`` first):

* items   (item_id, parent_id, period_text, ordinal_text)   strings
* ratings (item_id, score, weight)
* types   (item_id, item_type)                               several rows per id allowed
* selected(entity_id)                                        entities of interest
* entity basics (entity_id, title, start_year, end_year, genres)

Rule order (first failing rule wins): not_selected, period_null,
period_invalid, period_zero, ordinal_null, ordinal_invalid, unrated,
score_null, weight_null, type_missing, type_wrong. The first six need the
item alone. The rest are checked on the inner join of items and ratings: an item
with several rating rows counts once per rating, incomplete ratings go
after the join.

Plan of ``check_items``:

1. Items that pass the item-stage rules are written once, with their count and a
   frequent-items sketch of their ids observed on the way.
2. Where the counts say that it pays, a Bloom filter of these ids reduces the ratings
   and types in their scans, and what is left of the ratings is written with its
   own sketch. The types become one number per item (a hash aggregate
   without string states).
3. Items, ratings and types meet on the item id; ids that the sketches
   found hot are dealt over a grid (``skew.split_join``).

The selected-entity list is broadcast only when its counted size is small.

Documented deviation: first-wins de-duplication of types is "smallest type"
instead of file order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import first_reason
from tidemark.operators.bloom import MAX_BYTES, keep_known, key_filter, pays
from tidemark.operators.dedupe import dedupe_first
from tidemark.operators.joins import MAX_BROADCAST_ROWS, attach
from tidemark.operators.skew import MIN_PART_ROWS, Split, heavy_hitters, salts, split_join
from tidemark.session import materialize_observed

# Reject reasons in rule order (fixed values).
REASONS = (
    "not_selected",
    "period_null",
    "period_invalid",
    "period_zero",
    "ordinal_null",
    "ordinal_invalid",
    "unrated",
    "score_null",
    "weight_null",
    "type_missing",
    "type_wrong",
)
ITEM_STAGE = REASONS[:6]  # rules applied before the ratings join

CLEAN_COLUMNS = ["item_id", "entity_id", "period", "ordinal", "score", "weight"]


@dataclass(frozen=True)
class CleanRules:
    valid_types: Sequence[str] = ("tvEpisode",)
    max_broadcast_rows: int = MAX_BROADCAST_ROWS
    max_filter_bytes: int = MAX_BYTES  # no Bloom filter beyond
    min_part_rows: int = MIN_PART_ROWS  # no splitting of keys with fewer rows


def item_stage(items: DataFrame, selected: DataFrame | None, rules: CleanRules = CleanRules(),
               selected_rows: int | None = None) -> DataFrame:
    """Every raw item row with typed columns and the first item-stage rule it fails (``_item_reason``)."""
    rows = items
    if selected is not None:
        sel = selected.select(F.col("entity_id").cast("string").alias("parent_id")).distinct().withColumn(
            "_selected", F.lit(True)
        )
        rows = attach(rows, sel, ["parent_id"], "left", table_rows=selected_rows,
                      max_broadcast_rows=rules.max_broadcast_rows)
    else:
        rows = rows.withColumn("_selected", F.lit(True))

    period = F.col("period_text").try_cast("int")
    ordinal = F.col("ordinal_text").try_cast("int")
    item_reason = first_reason(
        [
            ("not_selected", F.col("_selected").isNull()),
            ("period_null", F.col("period_text").isNull()),
            ("period_invalid", period.isNull()),
            ("period_zero", period == 0),
            ("ordinal_null", F.col("ordinal_text").isNull()),
            ("ordinal_invalid", ordinal.isNull()),
            # a missing id matches no rating (and would send all such rows to one task)
            ("unrated", F.col("item_id").isNull()),
        ]
    )
    return rows.select("item_id", F.col("parent_id").alias("entity_id"), period.alias("period"),
                       ordinal.alias("ordinal"), item_reason.alias("_item_reason"))


def type_codes(types: DataFrame, rules: CleanRules) -> DataFrame:
    """(item_id, type_code): the smallest type of each item as a number. Codes follow the order of the
    types: odd = the valid type at ``code // 2`` of the sorted list, even = one between them."""
    t, valid = F.col("item_type").cast("string"), sorted(set(rules.valid_types))
    below = sum(((t > v).cast("int") for v in valid), F.lit(0))
    code = 2 * below + t.isin(*valid).cast("int")
    return types.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min(code).alias("type_code"))


def _valid_type(rules: CleanRules) -> Column:
    valid = F.array(*[F.lit(v) for v in sorted(set(rules.valid_types))])
    return F.when(F.col("type_code") % 2 == 1, F.get(valid, F.floor(F.col("type_code") / 2).cast("int")))


def typed_ratings(ratings: DataFrame) -> DataFrame:
    return ratings.select("item_id", F.col("score").cast("double").alias("score"),
                          F.col("weight").cast("bigint").alias("weight"), F.lit(True).alias("_rated"))


def _checked(joined: DataFrame, rules: CleanRules) -> DataFrame:
    """Reasons of the rules that need a rating or a type."""
    reason = first_reason(
        [
            ("unrated", F.col("_rated").isNull()),
            ("score_null", F.col("score").isNull()),
            ("weight_null", F.col("weight").isNull()),
            ("type_missing", F.col("type_code").isNull()),
            ("type_wrong", F.col("type_code") % 2 == 0),
        ]
    )
    return joined.select("item_id", "entity_id", "period", "ordinal", "score", "weight",
                         _valid_type(rules).alias("item_type"), reason.alias("reject_reason"))


def _passed(stage: DataFrame, ok: Column, reason: str) -> tuple[DataFrame, dict, int]:
    """The rows of ``stage`` that are ``ok``, written once; their count and frequent ids; the rows of ``stage``."""
    all_rows = Observation()
    counted = stage.observe(all_rows, F.count(F.lit(1)).alias("rows"))
    passed, seen = materialize_observed(counted.filter(ok).drop(reason), hot=heavy_hitters(F.col("item_id")))
    return passed, seen, all_rows.get["rows"]


def check_items(stage: DataFrame, ratings: DataFrame, types: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """Rows of an ``item_stage`` that passed it, once per matching rating (once if there is none), with their reason."""
    passed, seen, total = _passed(stage, F.col("_item_reason").isNull(), "_item_reason")
    rated, types = typed_ratings(ratings).filter(F.col("item_id").isNotNull()), types.select("item_id", "item_type")
    if pays(seen["rows"], total):
        known = key_filter(passed, "item_id", seen["rows"], rules.max_filter_bytes)
        near, met = materialize_observed(keep_known(rated, "item_id", known), hot=heavy_hitters(F.col("item_id")))
        types = keep_known(types, "item_id", known)
    else:  # most ratings match: they are counted in a pass over their ids instead of being written
        near, met = rated, rated.agg(F.count(F.lit(1)).alias("rows"), heavy_hitters(F.col("item_id")).alias("hot")).first()
    split = Split(salts(seen["hot"], seen["rows"], rules.min_part_rows), salts(met["hot"], met["rows"], rules.min_part_rows))
    return _checked(split_join(passed, near, "item_id", split, "left", "_rated", per_key=type_codes(types, rules)), rules)


def rejected_items(stage: DataFrame) -> DataFrame:
    """Rows of an ``item_stage`` that failed it, in the layout of ``check_items``."""
    return stage.filter(F.col("_item_reason").isNotNull()).select(
        "item_id", "entity_id", "period", "ordinal", F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("bigint").alias("weight"), F.lit(None).cast("string").alias("item_type"),
        F.col("_item_reason").alias("reject_reason"))


def tag_items(
    items: DataFrame,
    ratings: DataFrame,
    types: DataFrame,
    selected: DataFrame | None,
    rules: CleanRules = CleanRules(),
    selected_rows: int | None = None,
) -> DataFrame:
    """C1 + C3: every raw item row (once per matching rating) with typed columns and its reject reason;
    ``item_type`` is the valid type, NULL for other types.

    ``selected=None`` skips the parent filter. ``selected_rows`` is a proven
    bound on the size of ``selected`` if known (enables the broadcast)."""
    stage = item_stage(items, selected, rules, selected_rows)
    return check_items(stage, ratings, types, rules).unionByName(rejected_items(stage))


def tag_batch(items: DataFrame, ratings: DataFrame, codes: DataFrame, selected: DataFrame | None,
              rules: CleanRules = CleanRules()) -> DataFrame:
    """``tag_items`` of one arriving batch against ``typed_ratings`` and ``type_codes`` written before."""
    stage = item_stage(items, selected, rules)
    passed = stage.filter(F.col("_item_reason").isNull()).drop("_item_reason")
    joined = passed.join(ratings, "item_id", "left").join(codes, "item_id", "left")
    return _checked(joined, rules).unionByName(rejected_items(stage))


def clean_items(tagged: DataFrame) -> DataFrame:
    """C1 output: rows that passed every rule, fixed column order."""
    return tagged.filter(F.col("reject_reason").isNull()).select(*CLEAN_COLUMNS)


def clean_funnel(tagged: DataFrame) -> DataFrame:
    """Rows per outcome ('kept' or the first failing rule) and zero-weight kept rows."""
    outcome = F.coalesce(F.col("reject_reason"), F.lit("kept"))
    return tagged.groupBy(outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if((F.col("reject_reason").isNull()) & (F.col("weight") == 0)).alias("zero_weight_rows"),
    )


def item_types(tagged: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """One row per item that passed the item-level rules and has a valid type
    (a superset of the clean items: unrated items stay in)."""
    passed_items = F.col("reject_reason").isNull() | ~F.col("reject_reason").isin(*ITEM_STAGE)
    return (
        tagged.filter(passed_items & F.col("item_type").isin(*rules.valid_types))
        .groupBy("item_id")
        .agg(F.min("item_type").alias("item_type"))
    )


def entity_metadata(basics: DataFrame, selected: DataFrame | None, selected_rows: int | None = None,
                    rules: CleanRules = CleanRules()) -> DataFrame:
    """C4: one metadata row per selected entity (type of the entity row not checked)."""
    rows = basics
    if selected is not None:
        sel = selected.select(F.col("entity_id").cast("string").alias("entity_id")).distinct()
        rows = attach(rows.withColumn("entity_id", F.col("entity_id").cast("string")), sel, ["entity_id"],
                      "left_semi", table_rows=selected_rows, max_broadcast_rows=rules.max_broadcast_rows)
    return dedupe_first(rows, ["entity_id"], ["title", "start_year", "end_year", "genres"]).select(
        "entity_id", "title", "start_year", "end_year", "genres"
    )


def _whole(items: DataFrame, column: str) -> Column:
    """A whole number that may be written as a decimal (a column with blanks often is): 1.0 is 1,
    1.5 and other text are NULL. No cast fails on text that is a number."""
    kind, c = items.schema[column].dataType, F.col(column)
    if isinstance(kind, T.IntegralType):
        return c.cast("bigint")
    if isinstance(kind, T.FractionalType):
        return F.when((c == F.floor(c)) & (F.abs(c) < F.lit(2.0**63)), c.try_cast("bigint"))
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    return F.when(text.rlike(r"^[+-]?[0-9]{1,18}(\.0*)?$"), F.substring_index(text, ".", 1).try_cast("bigint")).when(
        text.rlike(r"^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$") & (number == F.floor(number)) & (F.abs(number) < F.lit(2.0**63)),
        number.try_cast("bigint"))


def prejoined_tag(items: DataFrame, types: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """Pre-joined input (item, entity, period, ordinal, score, weight): same
    rules, no parent filter; type check = membership in the valid-type item set.

    The type check comes last, so only rows that pass the others meet the types, reduced by a
    Bloom filter of their ids; hot ids are split."""
    period = _whole(items, "period").try_cast("int")
    ordinal = _whole(items, "ordinal").try_cast("int")
    typed = items.select(
        "item_id", "entity_id", period.alias("period"), ordinal.alias("ordinal"),
        F.col("score").try_cast("double").alias("score"), _whole(items, "weight").alias("weight"),
        F.col("period").isNull().alias("_no_period"), F.col("ordinal").isNull().alias("_no_ordinal"),
    )
    reason = first_reason(
        [
            ("period_null", F.col("_no_period")),
            ("period_invalid", F.col("period").isNull()),
            ("period_zero", F.col("period") == 0),
            ("ordinal_null", F.col("_no_ordinal")),
            ("ordinal_invalid", F.col("ordinal").isNull()),
            ("score_null", F.col("score").isNull()),
            ("weight_null", F.col("weight").isNull()),
            ("type_invalid", F.col("item_id").isNull()),  # a missing id is in no set
        ]
    )
    stage = typed.select(*[c for c in typed.columns if not c.startswith("_no_")], reason.alias("reject_reason"))
    # all rows are results here: they are written once, typed, and the checks aren't repeated in filters
    ok = F.col("reject_reason").isNull()
    stored, seen = materialize_observed(stage, ok=F.count_if(ok), hot=heavy_hitters(F.when(ok, F.col("item_id"))))
    passed = stored.filter(ok).drop("reject_reason")
    valid = types.filter(F.col("item_type").isin(*rules.valid_types)).select(F.col("item_id").cast("string").alias("item_id"))
    if pays(seen["ok"], seen["rows"]):
        valid = keep_known(valid, "item_id", key_filter(passed, "item_id", seen["ok"], rules.max_filter_bytes))
    valid = valid.filter(F.col("item_id").isNotNull()).distinct().withColumn("_valid", F.lit(True))
    split = Split(salts(seen["hot"], seen["ok"], rules.min_part_rows), {})
    checked = split_join(passed, valid, "item_id", split, "left", "_valid").select(
        *passed.columns, F.when(F.col("_valid").isNull(), "type_invalid").alias("reject_reason"))
    return checked.unionByName(stored.filter(~ok))
