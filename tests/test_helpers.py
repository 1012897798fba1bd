"""Small helpers: cluster sizing, input gate, stage tables, expression builders."""

from pyspark.sql import functions as F

from tidemark.functions.exprs import castable_fails, first_reason, safe_ratio, share_pct
from tidemark.session import cluster_conf, materialize_observed, stage_folder
from tidemark.sources.sinks import input_gate


def test_cluster_conf_sizes_partitions():
    c = cluster_conf(input_bytes=100 * 2**40, total_cores=8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 << 20)
    assert c["spark.sql.autoBroadcastJoinThreshold"] == "-1"
    small = cluster_conf(input_bytes=2**30, total_cores=64)
    assert int(small["spark.sql.shuffle.partitions"]) == 128  # at least two waves of the cores


def test_input_gate_reports_missing_columns(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    row = input_gate(df, "t", ["x", "z"]).first()
    assert (row["input"], row["missing_columns"], row["row_count"], row["ok"]) == ("t", "z", 1, False)
    empty = input_gate(df.filter("x > 5"), "t", ["x"]).first()
    assert (empty["row_count"], empty["ok"]) == (0, False)


def test_stage_tables_live_in_one_application_folder(spark):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    stored, seen = materialize_observed(df, total=F.sum("v"))
    assert seen["rows"] == 10 and seen["total"] == 90
    def bare(path):
        return path.replace("file://", "").replace("file:", "")

    assert bare(stored.inputFiles()[0]).startswith(bare(stage_folder(spark)))


def test_expression_builders(spark):
    df = spark.createDataFrame([("1", 4.0, 0), ("x", None, 2), (None, 1.0, 4)], "t string, a double, b int")
    out = df.select(
        castable_fails("t", "int", True).alias("int_fail"),
        castable_fails("t", "int", False).alias("int_fail_no_null"),
        safe_ratio("a", "b").alias("ratio"),
        share_pct(F.lit(1), "b").alias("pct"),
        first_reason([("r1", F.col("t").isNull()), ("r2", F.col("a").isNull())]).alias("reason"),
    ).collect()
    assert [r["int_fail"] for r in out] == [False, True, True]
    assert [r["int_fail_no_null"] for r in out] == [False, True, False]
    assert [r["ratio"] for r in out] == [None, None, 0.25]
    assert [r["pct"] for r in out] == [None, 50.0, 25.0]
    assert [r["reason"] for r in out] == [None, "r2", "r1"]
