"""The stream applies the same rules as the batch cleaning, per arriving file."""

import os
import tempfile

from tidemark.operators import ingest
from tidemark.streaming import ingest_arriving_items

FILES = [
    "tconst\tparentTconst\tseasonNumber\tepisodeNumber\ni1\tA\t1\t1\ni2\tA\t\\N\t2\n",
    "tconst\tparentTconst\tseasonNumber\tepisodeNumber\ni3\tB\t1\t1\ni4\tA\t2\t1\ni5\tA\t0\t3\n",
]


def test_stream_matches_batch_rules(spark):
    root = tempfile.mkdtemp(prefix="tidemark-stream-")
    src = os.path.join(root, "in")
    os.makedirs(src)
    for i, text in enumerate(FILES):
        with open(os.path.join(src, f"part{i}.tsv"), "w") as f:
            f.write(text)
    ratings = spark.createDataFrame([(f"i{n}", 8.0, 10) for n in range(1, 6)], "item_id string, score double, weight bigint")
    types = spark.createDataFrame([(f"i{n}", "tvEpisode") for n in range(1, 6)], "item_id string, item_type string")
    sel = spark.createDataFrame([("A",)], "entity_id string")
    q = ingest_arriving_items(spark, src, ratings, types, sel, os.path.join(root, "out"),
                              os.path.join(root, "ckpt"), files_per_batch=1)
    q.awaitTermination(120)
    tagged = spark.read.parquet(os.path.join(root, "out"))
    got = {r["item_id"]: r["reject_reason"] for r in tagged.collect()}
    assert got == {"i1": None, "i2": "period_null", "i3": "not_selected", "i4": None, "i5": "period_zero"}
    assert {r["item_id"] for r in ingest.clean_items(tagged).collect()} == {"i1", "i4"}
