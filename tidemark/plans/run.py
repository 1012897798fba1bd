"""End-to-end batch job: raw dumps -> clean tables -> star schema -> metrics
-> reconciliation -> data quality, all written as Parquet (or CSV).

Stage boundaries are written tables (they survive executor loss and cut
lineage): the tagged item table, then the period frame (checkpoint inside
``SeriesTrend``). Everything else is derived from those two.

Outputs are versions (``sources.versions``): a job that dies leaves the tables of the run before, and
``release`` reads the tables of the last run that came to its end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ingest, model, quality, reconcile
from tidemark.operators.metrics import JoinPolicy, SeriesTrend
from tidemark.operators.segments import ROWS_PER_TASK
from tidemark.session import stage_scope
from tidemark.sources import raw
from tidemark.sources.sinks import export_csv
from tidemark.sources.versions import publish, write_version


# Column layouts of the cleaned CSV files of the pre-joined mode (fixed values).
PREJOINED_RENAMES = {"episode_tconst": "item_id", "show_tconst": "entity_id", "season_num": "period",
                     "episode_num": "ordinal", "avg_rating": "score", "num_votes": "weight"}
METADATA_RENAMES = {"show_tconst": "entity_id", "primary_title": "title"}
TYPE_RENAMES = {"episode_tconst": "item_id", "title_type": "item_type"}
CATEGORY_RENAMES = {"show_tconst": "entity_id"}


# Jobs count the periods before the windows, so an entity of very many periods is split over tasks.
JOB_POLICY = JoinPolicy(segment_rows=ROWS_PER_TASK)


@dataclass
class PrejoinedPaths:
    items: str
    metadata: str
    types: str
    categories: str


@dataclass
class RawPaths:
    items: str
    ratings: str
    basics: str
    categories: str
    selected: str  # CSV with an entity_id column


def _clearing_stages(job):
    """The job with its stage tables deleted at its end; what it returns reads written outputs only."""
    @wraps(job)
    def run(spark, *args, **kwargs):
        with stage_scope(spark):
            return job(spark, *args, **kwargs)

    return run


@_clearing_stages
def run_all(spark: SparkSession, paths: RawPaths, out_dir: str, rules: ingest.CleanRules = ingest.CleanRules(),
            policy: JoinPolicy = JOB_POLICY, is_sample: bool = False,
            csv_dir: str | None = None) -> dict[str, DataFrame]:
    """Run every stage and write its outputs under ``out_dir`` (Parquet versions). Returns
    the written tables re-read as DataFrames; ``csv_dir`` also exports them as
    header CSVs in presentation order."""
    out = out_dir.rstrip("/")
    basics = raw.raw_basics(spark, paths.basics)
    selected = spark.read.option("header", True).csv(paths.selected).select("entity_id")
    n_selected = selected.count()
    categories = raw.read_categories(spark, paths.categories)
    n_categories = categories.count()

    tagged = ingest.tag_items(
        raw.raw_items(spark, paths.items),
        raw.raw_ratings(spark, paths.ratings),
        basics.select("item_id", "item_type"),
        selected, rules, selected_rows=n_selected,
    )
    tagged = spark.read.parquet(write_version(tagged, f"{out}/tagged_items"))

    items = ingest.clean_items(tagged)
    types = ingest.item_types(tagged, rules)
    meta = ingest.entity_metadata(raw.entity_basics(basics), selected, n_selected, rules)
    dim = model.dim_entity(meta, categories, category_rows=n_categories)
    fact = model.fact_item(items)

    trend = SeriesTrend(fact, policy=policy)
    kpis = trend.kpis()
    entities = dim.select("entity_id").distinct()  # entities without metadata get no break row
    breaks = trend.break_period(entities)
    durable = trend.durability(entities)
    titles = categories.select("entity_id", "title")

    outputs = {
        "clean_items": items,
        "clean_funnel": _with_malformed(spark, ingest.clean_funnel(tagged), paths.items),
        "item_types": types,
        "entity_metadata": meta,
        "dim_entity": dim,
        "period_kpis": kpis,
        "break_period": breaks,
        "durability": durable,
        "entity_summary": trend.summary(entities),
    }
    return _finish(spark, out, outputs, trend, titles, selected, n_selected, n_categories, rules, is_sample,
                   csv_dir=csv_dir)


def _with_malformed(spark: SparkSession, funnel: DataFrame, path: str) -> DataFrame:
    """The funnel with the item lines that could not be read as rows (gzip dumps)."""
    if not path.endswith(".gz"):
        return funnel
    lost = raw.malformed_lines(spark, path).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 0")
    return funnel.unionByName(lost.select(F.lit("malformed").alias("outcome"), "row_count", F.lit(0).cast("bigint").alias("zero_weight_rows")))


def _csv(spark: SparkSession, path: str, renames: dict[str, str]) -> DataFrame:
    """Header CSV read as all-string (casts happen in the operators)."""
    return spark.read.option("header", True).csv(path).withColumnsRenamed(renames)


@_clearing_stages
def run_prejoined(spark: SparkSession, paths: PrejoinedPaths, out_dir: str,
                  rules: ingest.CleanRules = ingest.CleanRules(), policy: JoinPolicy = JOB_POLICY,
                  is_sample: bool = True, id_prefix: str | None = None,
                  csv_dir: str | None = None) -> dict[str, DataFrame]:
    """The pre-joined input mode (cleaned item CSV + metadata + item types):
    same rules without the parent filter; metadata and types pass through;
    the expected entities are those of the category table."""
    out = out_dir.rstrip("/")
    items = _csv(spark, paths.items, PREJOINED_RENAMES)
    types = _csv(spark, paths.types, TYPE_RENAMES).select("item_id", "item_type")
    meta = _csv(spark, paths.metadata, METADATA_RENAMES).select(
        "entity_id", "title", "start_year", "end_year", "genres")
    categories = _csv(spark, paths.categories, CATEGORY_RENAMES).select("entity_id", "title", "category")
    n_categories = categories.count()
    selected = categories.select("entity_id").distinct()

    tagged = ingest.prejoined_tag(items, types, rules)
    tagged = spark.read.parquet(write_version(tagged, f"{out}/tagged_items"))
    fact = model.fact_item(ingest.clean_items(tagged))
    trend = SeriesTrend(fact, policy=policy)
    titles = categories.select("entity_id", "title")
    dim = model.dim_entity(meta, categories, category_rows=n_categories)
    entities = dim.select("entity_id").distinct()
    outputs = {
        "clean_items": ingest.clean_items(tagged),
        "clean_funnel": ingest.clean_funnel(tagged),
        "item_types": types,
        "entity_metadata": meta,
        "dim_entity": dim,
        "period_kpis": trend.kpis(),
        "break_period": trend.break_period(entities),
        "durability": trend.durability(entities),
        "entity_summary": trend.summary(entities),
    }
    return _finish(spark, out, outputs, trend, titles, selected, n_categories, n_categories, rules, is_sample,
                   id_prefix, csv_dir)


def _finish(spark, out, outputs, trend, titles, selected, n_selected, n_categories, rules, is_sample,
            id_prefix=None, csv_dir=None) -> dict[str, DataFrame]:
    """Write the model/metric outputs, then the reports computed from the written tables."""
    folders = {name: write_version(df, f"{out}/{name}", keep=None) for name, df in outputs.items()}
    written = {name: spark.read.parquet(folder) for name, folder in folders.items()}
    expected = selected.select(F.col("entity_id").cast("string").alias("entity_id"))

    k, b = written["period_kpis"], written["break_period"]
    counts = reconcile.reconcile_counts(written["clean_items"], k, titles, titles_rows=n_categories)
    spot = reconcile.spot_check(written["clean_items"], k, titles, kpi_rows=trend.rows, titles_rows=n_categories)
    dups = reconcile.duplicate_items(written["clean_items"])
    sanity = reconcile.break_sanity(b, k, titles, titles_rows=n_categories, kpi_rows=trend.rows)
    reports = {
        "reconcile_counts": counts,
        "spot_check": spot,
        "duplicate_keys": dups,
        "break_sanity": sanity,
        "weight_extremes": reconcile.weight_extremes(written["clean_items"], titles, titles_rows=n_categories),
        "qa_summary": reconcile.qa_summary(counts, spot, dups, sanity, is_sample),
        "dq_checks": quality.dq_checks(
            written["clean_items"], written["entity_metadata"], written["item_types"], k, b,
            written["durability"], expected,
            quality.QualityRules(valid_types=rules.valid_types, rederive_breaks=is_sample, id_prefix=id_prefix),
            n_selected,
        ),
    }
    for name, df in reports.items():
        folders[name] = write_version(df, f"{out}/{name}", keep=None)
        written[name] = spark.read.parquet(folders[name])
    publish(spark, out, folders)
    if csv_dir:
        export_csv(written, csv_dir)
    return written
