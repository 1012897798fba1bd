"""Replace-and-create that never leaves a table without content.

Overwriting deletes the old files before the new ones are written, so a job that dies in between leaves
no table. Here each write goes to a new folder ``<path>/_versions/<number>-<id>`` and counts once Spark's
commit has put its ``_SUCCESS`` file there; that single file is the switch, so nothing is renamed and
object stores do as well as HDFS. Readers take the newest complete version, the last ``keep`` ones stay for
those who still read them, and a folder without the file (a job that died) is never read.

``publish`` writes the folders of one run's tables as a small versioned table of its own, so that
``release`` reads tables of one and the same run. Such runs write with ``keep=None``: only publishing
clears away, and never what a kept release names, however many runs died since.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "_versions"
MARKER = "_SUCCESS"
KEEP = 2
_RELEASE = "_release"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _folders(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(folder name, complete) of all versions, oldest first."""
    fs, where = _fs(spark, f"{path.rstrip('/')}/{FOLDER}")
    names = [folder.rpartition("/")[2] for folder in subfolders(spark, f"{path.rstrip('/')}/{FOLDER}")]
    return [(n, fs.exists(spark._jvm.org.apache.hadoop.fs.Path(where, f"{n}/{MARKER}"))) for n in names]


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Folders directly under ``path`` (none if it isn't there), by name."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    return sorted(f"{path.rstrip('/')}/{s.getPath().getName()}" for s in fs.listStatus(where) if s.isDirectory())


def versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the complete versions, oldest first."""
    return [f"{path.rstrip('/')}/{FOLDER}/{n}" for n, complete in _folders(spark, path) if complete]


def write_version(df: DataFrame, path: str, fmt: str = "parquet", keep: int | None = KEEP, **options) -> str:
    """Write ``df`` as the newest version of the table at ``path``; returns its folder. Of two writers at the
    same time both succeed and every reader sees the same one as the newer. ``keep=None`` deletes nothing."""
    if keep is not None and keep < 1:
        raise ValueError("keep at least the version just written")
    spark, path = df.sparkSession, path.rstrip("/")
    known = _folders(spark, path)
    number = int(known[-1][0].split("-")[0]) + 1 if known else 1
    folder = f"{path}/{FOLDER}/{number:010d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("error").format(fmt).options(**options).save(folder)
    fs, marker = _fs(spark, f"{folder}/{MARKER}")
    if not fs.exists(marker):  # committers can be told to leave it out
        fs.create(marker).close()
    if keep is not None:
        drop_old(spark, path, keep)
    return folder


def _drop_before(spark: SparkSession, path: str, first: str) -> list[str]:
    gone = [n for n, _ in _folders(spark, path) if n < first]
    for name in gone:
        fs, where = _fs(spark, f"{path.rstrip('/')}/{FOLDER}/{name}")
        fs.delete(where, True)
    return gone


def drop_old(spark: SparkSession, path: str, keep: int = KEEP) -> list[str]:
    """Delete all versions before the last ``keep`` complete ones, unfinished ones among them; an unfinished
    folder that is newer may belong to a running job and stays. Returns the names of what went."""
    complete = [n for n, done in _folders(spark, path) if done]
    return _drop_before(spark, path, complete[-keep]) if len(complete) >= keep else []


def read_version(spark: SparkSession, path: str, fmt: str = "parquet", back: int = 0, **options) -> DataFrame:
    """The newest complete version of the table at ``path``, or the one ``back`` versions before it."""
    complete = versions(spark, path)
    if len(complete) <= back:
        raise FileNotFoundError(f"{path}: {len(complete)} complete versions")
    return spark.read.format(fmt).options(**options).load(complete[-1 - back])


def publish(spark: SparkSession, out_dir: str, folders: dict[str, str], keep: int = KEEP) -> None:
    """Make the version folders of one run (table name to folder) the current release of ``out_dir``, then
    delete what is older than the last ``keep`` releases."""
    where = f"{out_dir.rstrip('/')}/{_RELEASE}"
    write_version(spark.createDataFrame(sorted(folders.items()), "name string, folder string").coalesce(1), where, keep=keep)
    oldest: dict[str, str] = {}
    for back in range(len(versions(spark, where))):
        for r in read_version(spark, where, back=back).collect():  # a row a table
            table, _, version = r["folder"].rpartition(f"/{FOLDER}/")
            oldest[table] = min(version, oldest.get(table, version))
    for table, version in oldest.items():
        _drop_before(spark, table, version)


def release(spark: SparkSession, out_dir: str, back: int = 0) -> dict[str, DataFrame]:
    """The tables of the newest released run: all of one run, or of the run ``back`` releases before."""
    listed = read_version(spark, f"{out_dir.rstrip('/')}/{_RELEASE}", back=back).collect()  # a row a table
    return {r["name"]: spark.read.parquet(r["folder"]) for r in listed}
