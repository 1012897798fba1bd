"""Versioned outputs: what a dying job leaves, concurrent writers, clean-up, one run's tables together."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources.versions import MARKER, drop_old, publish, read_version, release, versions, write_version


def _ids(df):
    return sorted(r["id"] for r in df.collect())


def test_newest_version_is_read_and_old_ones_go(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n in (2, 3, 4):
        write_version(spark.range(n), path)
        assert _ids(read_version(spark, path)) == list(range(n))
    assert len(versions(spark, path)) == 2 and _ids(read_version(spark, path, back=1)) == [0, 1, 2]
    with pytest.raises(FileNotFoundError):
        read_version(spark, path, back=2)


def test_failed_write_leaves_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    write_version(spark.range(3), path)
    old = read_version(spark, path)
    broken = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="lost"):
        write_version(broken, path)
    assert _ids(read_version(spark, path)) == _ids(old) == [0, 1, 2]
    # a job killed while it wrote: files, but no marker
    dead = f"{path}/_versions/0000000009-dead"
    spark.range(50).write.parquet(dead)
    os.remove(f"{dead}/{MARKER}")
    assert _ids(read_version(spark, path)) == [0, 1, 2] and os.path.isdir(dead)
    write_version(spark.range(5), path)  # numbered behind the dead one
    assert _ids(read_version(spark, path)) == [0, 1, 2, 3, 4]
    write_version(spark.range(6), path)
    assert not os.path.isdir(dead) and len(versions(spark, path)) == 2


def test_replacing_a_table_by_what_was_read_from_it(spark, tmp_path):
    path = f"{tmp_path}/t"
    write_version(spark.range(3), path)
    write_version(read_version(spark, path).select((F.col("id") + 10).alias("id")), path)
    assert _ids(read_version(spark, path)) == [10, 11, 12]


def test_writers_at_the_same_time_and_empty_tables(spark, tmp_path):
    path = f"{tmp_path}/t"
    for name in ("0000000001-bbbb", "0000000001-aaaa"):
        spark.range(len(versions(spark, path)) + 1).write.parquet(f"{path}/_versions/{name}")
    assert _ids(read_version(spark, path)) == [0]  # the same for every reader, whoever ended last
    write_version(spark.range(0), path, keep=1)
    assert read_version(spark, path).columns == ["id"] and read_version(spark, path).count() == 0
    assert len(versions(spark, path)) == 1 and drop_old(spark, path, 5) == []
    with pytest.raises(ValueError):
        write_version(spark.range(1), path, keep=0)
    with pytest.raises(FileNotFoundError):
        read_version(spark, f"{tmp_path}/none")


def test_missing_marker_option_and_csv(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        write_version(spark.range(2), f"{tmp_path}/c", fmt="csv", header=True)
    finally:
        conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    assert sorted(r["id"] for r in read_version(spark, f"{tmp_path}/c", fmt="csv", header=True).collect()) == ["0", "1"]


def test_release_holds_tables_of_one_run(spark, tmp_path):
    out = str(tmp_path)

    def run(n, tables=("a", "b"), published=True):
        folders = {name: write_version(spark.range(n), f"{out}/{name}", keep=None) for name in tables}
        if published:
            publish(spark, out, folders)

    def sizes(back=0):
        return {k: v.count() for k, v in release(spark, out, back).items()}

    run(1)
    run(2)
    for n in (7, 8, 9):  # runs that died after their first table
        run(n, ["a"], published=False)
    assert sizes() == {"a": 2, "b": 2} and sizes(back=1) == {"a": 1, "b": 1}
    run(3)
    assert sizes() == {"a": 3, "b": 3} and sizes(back=1) == {"a": 2, "b": 2}
    run(4)
    # the dead runs' tables went with the releases before them
    assert len(versions(spark, f"{out}/a")) == len(versions(spark, f"{out}/b")) == 2
    assert sizes() == {"a": 4, "b": 4} and sizes(back=1) == {"a": 3, "b": 3}
