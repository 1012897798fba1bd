"""Incremental ingest: the chunked raw-dump read expressed as Structured Streaming.

The reference has no streaming logic; it reads its dumps in bounded chunks.
On Spark the same cleaning operator runs per micro-batch of arriving files.
"""

from tidemark.streaming.incremental import ingest_arriving_items

__all__ = ["ingest_arriving_items"]
