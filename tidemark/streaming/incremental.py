"""Clean raw item files as they arrive (``readStream`` → ``foreachBatch``).

Each micro-batch of new tab-separated item files goes through the same
rule chain as the batch job (``ingest.tag_batch``). The typed static ratings
and one type code per item are written once to the shared checkpoint
folder before the stream starts, and only joined per batch; the tagged rows are appended to a Parquet table that
``clean_items`` / ``clean_funnel`` then read. The stream's checkpoint
location must be in shared storage; the
sink is idempotent per batch id (a batch folder is overwritten on retry),
so a replayed batch after an executor or driver failure does not
duplicate rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import ingest
from tidemark.schemas import RAW_ITEM_SCHEMA
from tidemark.session import materialize
from tidemark.sources.raw import ITEM_RENAMES, NULL_TOKEN


def ingest_arriving_items(
    spark: SparkSession,
    items_dir: str,
    ratings: DataFrame,
    types: DataFrame,
    selected: DataFrame | None,
    out_path: str,
    checkpoint: str,
    rules: ingest.CleanRules = ingest.CleanRules(),
    files_per_batch: int = 16,
    available_now: bool = True,
):
    """Start the stream; returns the ``StreamingQuery``. With ``available_now``
    it processes every file present and stops (bounded, like a chunked read)."""
    raw = (
        spark.readStream.schema(RAW_ITEM_SCHEMA)
        .option("header", True)
        .option("sep", "\t")
        .option("nullValue", NULL_TOKEN)
        .option("quote", "")
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(items_dir)
        .withColumnsRenamed(ITEM_RENAMES)
    )

    rated = materialize(ingest.typed_ratings(ratings).filter("item_id IS NOT NULL"))
    codes = materialize(ingest.type_codes(types, rules))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        tagged = ingest.tag_batch(batch, rated, codes, selected, rules)
        tagged.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={batch_id}")

    writer = raw.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
