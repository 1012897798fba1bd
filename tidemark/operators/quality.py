"""Rule-based data-quality job (Q0-Q21) as one DataFrame of check rows.

Output: (check_id, check_name, status, observed) with status PASS, FAIL or
WARN (WARN only for the row-count parity check) and ``observed`` the
number of violations (or the measured count for grain checks).

Plan: one single-pass aggregate per table, plus one tag-and-group
aggregate per key (item id; entity id) that answers the uniqueness,
subset and set-equality checks of every table at once. The one-row
results are merged (union + max) and exploded into check rows; nothing
is collected to the driver. The job
passes when no row has status FAIL (``dq_passed``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import castable_fails
from tidemark.operators.joins import MAX_BROADCAST_ROWS

# Expected layouts (fixed values).
ITEM_COLUMNS = ["item_id", "entity_id", "period", "ordinal", "score", "weight"]
METADATA_COLUMNS = ["entity_id", "title", "start_year", "end_year", "genres"]
TYPE_COLUMNS = ["item_id", "item_type"]
KPI_COLUMNS = [
    "entity_id", "period", "item_count", "total_weight", "weighted_score", "mean_score", "score_stddev",
    "pct_high", "baseline", "rolling_mean", "period_rank", "value_index",
]
BREAK_COLUMNS = ["entity_id", "break_period"]
DURABILITY_COLUMNS = ["entity_id", "durability"]


@dataclass(frozen=True)
class QualityRules:
    score_min: float = 1.0
    score_max: float = 10.0
    valid_types: Sequence[str] = ("tvEpisode",)
    min_break_period: int = 3
    id_prefix: str | None = None  # synthetic-id check, sample data only
    rederive_breaks: bool = False  # independent break re-derivation, sample data only
    max_broadcast_rows: int = MAX_BROADCAST_ROWS


def _check(cid: str, name: str, observed: Column, ok: Column | None = None, fail: str = "FAIL") -> Column:
    ok = (observed == 0) if ok is None else ok
    return F.struct(
        F.lit(cid).alias("check_id"),
        F.lit(name).alias("check_name"),
        F.when(F.coalesce(ok, F.lit(False)), F.lit("PASS")).otherwise(F.lit(fail)).alias("status"),
        observed.cast("bigint").alias("observed"),
    )


def _combine(frames: list[DataFrame]) -> DataFrame:
    """Merge one-row stat frames (disjoint columns) into one row: union + max."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    cols = [c for f in frames for c in f.columns]
    return out.agg(*[F.max(c).alias(c) for c in cols])


def _explode(one_row: DataFrame, checks: list[Column]) -> DataFrame:
    return one_row.select(F.explode(F.array(*checks)).alias("_c")).select("_c.*")


def _missing_columns(df: DataFrame, expected: Sequence[str]) -> int:
    # Schema metadata, not data: no job runs here.
    return len(set(expected) - set(df.columns))


def _tags(sources: dict[str, DataFrame], key: str, tags: Sequence[str] = ()) -> DataFrame:
    """(key, a count per tag): 1 in the column of a row's source. Rows with summed counts mean the same."""
    tags = list(tags) or list(sources)
    frames = [
        df.select(F.col(key), *[F.lit(1 if t == tag else 0).cast("bigint").alias(t) for t in tags]) for tag, df in sources.items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _count_tags(tagged: DataFrame, key: str) -> DataFrame:
    return tagged.groupBy(key).agg(*[F.sum(t).alias(t) for t in tagged.columns if t != key])


def _presence(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Tag-and-group: one row per key value with the row count of each source.

    A single partial-aggregating ``groupBy`` answers uniqueness, subset and
    set-equality questions for all sources at once (no anti-joins)."""
    return _count_tags(_tags(sources, key), key)


def _per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def _extra(col: str) -> Column:
    """Rows beyond the first per key, summed over keys."""
    return F.coalesce(F.sum(F.greatest(F.col(col) - 1, F.lit(0))), F.lit(0))


def item_measures(items: DataFrame, metadata: DataFrame, types: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row of counts over items and item types (every column adds up over batches)."""
    s, w = F.col("score"), F.col("weight")
    cast_fail = (
        castable_fails("period", "int", True)
        | castable_fails("ordinal", "int", True)
        | castable_fails("score", "double", False)
        | castable_fails("weight", "bigint", True)
    )
    per_item = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(cast_fail).alias("cast_fail"),
        F.count_if(F.col("period").isNull() | (F.col("period") == 0)).alias("bad_period"),
        F.count_if(F.col("ordinal").isNull()).alias("null_ordinal"),
        F.count_if(s.isNull() | (s < F.lit(rules.score_min)) | (s > F.lit(rules.score_max))).alias("bad_score"),
        F.count_if(w.isNull() | (w < 0)).alias("bad_weight"),
    ]
    if rules.id_prefix is not None:
        per_item.append(F.count_if(~F.coalesce(F.col("item_id").startswith(rules.id_prefix), F.lit(False))).alias("bad_prefix"))
    ia = items.agg(*per_item)
    ta = types.agg(
        F.count(F.lit(1)).alias("type_rows"),
        F.count_if(~F.coalesce(F.col("item_type").isin(*rules.valid_types), F.lit(False))).alias("bad_types"),
    )
    schema = [
        F.lit(_missing_columns(df, wanted)).cast("bigint").alias(name)
        for name, df, wanted in (("no_item_columns", items, ITEM_COLUMNS), ("no_metadata_columns", metadata, METADATA_COLUMNS),
                                 ("no_type_columns", types, TYPE_COLUMNS))
    ]
    return _combine([ia, ta]).select("*", *schema)


def item_key_tags(items: DataFrame, types: DataFrame) -> DataFrame:
    """Item ids with their rows among items (i) and item types (t); may be summed by id."""
    return _tags({"i": items, "t": types}, "item_id")


ENTITY_TAGS = ["i", "e", "m"]


def entity_key_tags(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """Entity ids with their rows among items (i) and metadata (m); the expected ones (e) come later."""
    return _tags({"i": items, "m": metadata}, "entity_id", ENTITY_TAGS)


def item_checks(items: DataFrame, metadata: DataFrame, types: DataFrame, expected: DataFrame,
                rules: QualityRules = QualityRules(), expected_rows: int | None = None) -> DataFrame:
    """Phase 1: Q1-Q11 over the cleaned items, entity metadata and item types."""
    return item_results(item_measures(items, metadata, types, rules), item_key_tags(items, types),
                        entity_key_tags(items, metadata), expected, rules)


def item_results(measures: DataFrame, item_keys: DataFrame, entity_keys: DataFrame, expected: DataFrame,
                 rules: QualityRules = QualityRules()) -> DataFrame:
    """The checks Q1-Q11 from one row of counts and the keys' counts of rows."""
    ids = _count_tags(item_keys, "item_id").agg(
        _extra("i").alias("dup_items"),
        _extra("t").alias("dup_types"),
        # a NULL id never matches (anti-join semantics)
        F.count_if((F.col("i") > 0) & ((F.col("t") == 0) | F.col("item_id").isNull())).alias("missing_types"),
    )
    e, i, m = F.col("e") > 0, F.col("i") > 0, F.col("m") > 0
    known = F.col("entity_id").isNotNull()
    ents = _count_tags(entity_keys.unionByName(_tags({"e": expected}, "entity_id", ENTITY_TAGS)), "entity_id").agg(
        F.count_if(i & (~e | ~known)).alias("unknown_entities"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("meta_rows"),
        F.count_if(e).alias("expected_n"),
        F.count_if(known & (m != e)).alias("meta_diff"),
    )
    one = _combine([measures, ids, ents])
    checks = [
        _check("Q1a", "items columns", F.col("no_item_columns")),
        _check("Q1b", "metadata columns", F.col("no_metadata_columns")),
        _check("Q1c", "item types columns", F.col("no_type_columns")),
        _check("Q1d", "items castable", F.col("cast_fail")),
        _check("Q2", "unique item id", F.col("dup_items")),
        _check("Q3a", "period not NULL or 0", F.col("bad_period")),
        _check("Q3b", "ordinal not NULL", F.col("null_ordinal")),
        _check("Q4a", "score in range, not NULL", F.col("bad_score")),
        _check("Q4b", "weight >= 0, not NULL", F.col("bad_weight")),
        _check("Q5", "item entities known", F.col("unknown_entities")),
        _check("Q6", "item types valid", F.col("bad_types")),
        _check("Q7", "unique item id in types", F.col("dup_types")),
        _check("Q8", "items subset of types", F.col("missing_types")),
        _check("Q9", "row counts equal", F.abs(F.col("rows") - F.col("type_rows")), fail="WARN"),
        _check("Q10a", "metadata has one row per expected entity", F.abs(F.col("meta_rows") - F.col("expected_n"))),
        _check("Q10b", "metadata entities equal expected", F.col("meta_diff")),
    ]
    if rules.id_prefix is not None:
        checks.append(_check("Q11", "synthetic id prefix", F.col("bad_prefix")))
    return _explode(one, checks)


def _first_pair_strict(kpis: DataFrame) -> DataFrame:
    """Per entity, first period whose next existing period is also below."""
    ordered = Window.partitionBy("entity_id").orderBy(F.col("period").asc_nulls_first())
    below = F.col("rolling_mean") < F.col("baseline")
    flagged = kpis.select("entity_id", "period", F.coalesce(below, F.lit(False)).alias("_below")).withColumn(
        "_prev_below", F.lag("_below").over(ordered)
    ).withColumn("_prev_period", F.lag("period").over(ordered))
    return flagged.groupBy("entity_id").agg(
        F.min(F.when(F.col("_below") & F.col("_prev_below"), F.col("_prev_period"))).alias("_expected")
    )


def metric_checks(kpis: DataFrame, breaks: DataFrame, durability: DataFrame, expected: DataFrame,
                  rules: QualityRules = QualityRules(), expected_rows: int | None = None) -> DataFrame:
    """Phase 2: Q12-Q21 over the KPI, break and durability tables."""
    wr, vi = F.col("weighted_score"), F.col("value_index")
    cast_fail = (
        castable_fails("period", "int", True)
        | castable_fails("item_count", "bigint", True)
        | castable_fails("weighted_score", "double", False)
        | castable_fails("value_index", "double", False)
    )
    ka = kpis.agg(
        F.count_if(cast_fail).alias("kpi_cast_fail"),
        F.count_if(F.col("period").isNull() | (F.col("period") <= 0)).alias("bad_kpi_period"),
        F.count_if(F.col("item_count").isNull() | (F.col("item_count") <= 0)).alias("bad_item_count"),
        F.count_if((wr < F.lit(rules.score_min)) | (wr > F.lit(rules.score_max))).alias("bad_wr"),
        F.count_if(vi <= 0).alias("bad_vi"),
    )
    kdup = _per_key(kpis, ["entity_id", "period"]).agg(_extra("_n").alias("dup_kpi"))
    ba = breaks.agg(
        F.count_if(F.col("break_period").isNotNull() & (F.col("break_period") < rules.min_break_period)).alias(
            "bad_break"
        ),
        F.count_if(F.col("break_period").isNotNull()).alias("triggered"),
    )
    da = durability.agg(F.count_if(F.col("durability").isNull() | (F.col("durability") < 0)).alias("bad_dur"))
    k, b, d, e = (F.col(x) > 0 for x in ("k", "b", "d", "e"))
    known = F.col("entity_id").isNotNull()
    ents = _presence({"k": kpis, "b": breaks, "d": durability, "e": expected}, "entity_id").agg(
        F.count_if(k & (~e | ~known)).alias("unknown_kpi"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("break_rows"),
        F.count_if(b & known).alias("break_entities"),
        F.count_if(known & (b != e)).alias("break_diff"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("dur_rows"),
        F.count_if(d & known).alias("dur_entities"),
        F.count_if(known & (d != e)).alias("dur_diff"),
        F.count_if(e).alias("expected_n"),
        F.count_if(
            k.cast("int") + b.cast("int") + d.cast("int") + e.cast("int") < 4
        ).alias("set_diff"),
    )
    stats = [ka, kdup, ba, da, ents]
    checks = [
        _check("Q12a", "kpi columns", F.lit(_missing_columns(kpis, KPI_COLUMNS))),
        _check("Q12b", "kpi castable", F.col("kpi_cast_fail")),
        _check("Q13", "unique (entity, period)", F.col("dup_kpi")),
        _check("Q14", "kpi entities known", F.col("unknown_kpi")),
        _check("Q15a", "period > 0, not NULL", F.col("bad_kpi_period")),
        _check("Q15b", "item count > 0", F.col("bad_item_count")),
        _check("Q16a", "weighted score in range", F.col("bad_wr")),
        _check("Q16b", "value index > 0", F.col("bad_vi")),
        _check("Q17a", "break columns", F.lit(_missing_columns(breaks, BREAK_COLUMNS))),
        _check("Q17b", "one break row per expected entity",
               (F.col("break_rows") - F.col("break_entities")) + F.col("break_diff")),
        _check("Q17c", "break NULL or >= minimum", F.col("bad_break")),
        _check("Q18a", "durability columns", F.lit(_missing_columns(durability, DURABILITY_COLUMNS))),
        _check("Q18b", "one durability row per expected entity",
               (F.col("dur_rows") - F.col("dur_entities")) + F.col("dur_diff")),
        _check("Q18c", "durability not NULL, >= 0", F.col("bad_dur")),
        _check("Q20a", "break rows = expected entities", F.abs(F.col("break_rows") - F.col("expected_n"))),
        _check("Q20b", "durability rows = expected entities", F.abs(F.col("dur_rows") - F.col("expected_n"))),
        _check("Q21", "entity sets identical across outputs", F.col("set_diff")),
    ]
    if rules.rederive_breaks:
        strict = _first_pair_strict(kpis)
        mism = (
            breaks.filter(F.col("break_period").isNotNull())
            .join(strict, "entity_id", "left")
            .agg(
                F.count_if(
                    F.col("_expected").isNull() | (F.col("_expected") != F.col("break_period"))
                ).alias("rederive_mismatch")
            )
        )
        stats.append(mism)
        checks += [
            _check("Q19a", "at least one entity breaks", F.col("triggered"), ok=F.col("triggered") > 0),
            _check("Q19b", "break matches re-derivation", F.col("rederive_mismatch")),
        ]
    return _explode(_combine(stats), checks)


def dq_checks(items, metadata, types, kpis, breaks, durability, expected, rules: QualityRules = QualityRules(),
              expected_rows: int | None = None) -> DataFrame:
    """Both phases, one row per check."""
    return item_checks(items, metadata, types, expected, rules, expected_rows).unionByName(
        metric_checks(kpis, breaks, durability, expected, rules, expected_rows)
    )


def dq_passed(checks: DataFrame) -> DataFrame:
    """Overall status: one row, ``passed`` = no FAIL rows."""
    return checks.agg(
        (F.count_if(F.col("status") == "FAIL") == 0).alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failures"),
        F.count_if(F.col("status") == "WARN").alias("warnings"),
        F.count(F.lit(1)).alias("checks"),
    )


# -- standalone building blocks (also registered as queries) -----------------
def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One single-pass aggregate; one row per numeric column with its
    minimum, maximum and NULL count (min/max skip NULLs)."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).cast("double").alias(f"_min_{c}"), F.max(c).cast("double").alias(f"_max_{c}"),
                 F.count_if(F.col(c).isNull()).alias(f"_null_{c}")]
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_min_{c}").alias("min_value"),
                 F.col(f"_max_{c}").alias("max_value"), F.col(f"_null_{c}").alias("null_count"))
        for c in columns
    ])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` absent from ``right`` (left is a
    subset of right iff this is empty). Tag-and-group, so a hot key is
    reduced map-side; a NULL key never matches."""
    pres = _presence({"l": left, "r": right}, key)
    return pres.filter((F.col("l") > 0) & ((F.col("r") == 0) | F.col(key).isNull())).select(key)


def key_set_equality(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Per key value, which sources contain it and whether all do."""
    pres = _presence(sources, key)
    flags = [(F.col(t) > 0).alias(f"in_{t}") for t in sources]
    every = None
    for t in sources:
        every = (F.col(t) > 0) if every is None else every & (F.col(t) > 0)
    return pres.select(key, *flags, every.alias("all_present"))
