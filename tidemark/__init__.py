"""tidemark — find where a long-running series loses quality, on Spark.

Every operator is DataFrame in, DataFrame out, built from Spark SQL
expressions, aggregates and windows. No Python UDFs, no driver-side data.

Layout:
    functions/  column-expression helpers (weighted mean, safe ratio, ...)
    sources/    readers/writers and the mapping of the driver test tables
    operators/  ingest, model, metrics, reconcile, quality, marts
    plans/      end-to-end batch jobs and the named query catalog
    streaming/  incremental ingest of arriving raw files (foreachBatch)
"""

from tidemark.schemas import SeriesCols

__all__ = ["SeriesCols"]
