"""The splittable gzip reader: members, ranges, lines across both, malformed lines."""

import gzip
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.sources import gzip_dump, raw

HEADER = "tconst\tparentTconst\tseasonNumber\tepisodeNumber\n"


def made(n, seed=1):
    rng = random.Random(seed)
    return [f"i{i}\t{rng.choice(['A', 'B', chr(233)])}\t{rng.choice(['1', chr(92) + 'N', ''])}\t{rng.randrange(99)}\n" for i in range(n)]


def write(path, text, cuts, pad=b""):
    """``text`` as one gzip member per part between ``cuts`` (byte positions)."""
    data = text.encode()
    edges = [0, *sorted(cuts), len(data)]
    with open(path, "wb") as f:
        f.write(b"".join(gzip.compress(data[a:b], 6) for a, b in zip(edges, edges[1:])) + pad)
    return os.path.getsize(path)


@pytest.mark.parametrize("seed", range(6))
def test_every_line_is_read_once_whatever_members_and_ranges(tmp_path, seed):
    rng = random.Random(seed)
    text = HEADER + "".join(made(rng.randrange(0, 400), seed)) + rng.choice(["", "last\tline"])
    cuts = [rng.randrange(len(text.encode()) + 1) for _ in range(rng.randrange(0, 25))]
    path = str(tmp_path / "d.gz")
    size = write(path, text, cuts, rng.choice([b"", b"\0" * 300]))
    with pa.OSFile(path) as f:
        for step in (1, 13, 100, 997, size):
            got = b"".join(b for s in range(0, size, step) for b in gzip_dump.lines(f, size, s, min(s + step, size)))
            assert got.decode() == text


def test_chance_magic_is_no_member(tmp_path):
    inner = random.Random(2).randbytes(3000).replace(b"\n", b"") + gzip_dump.MAGIC + b"\x00" * 20
    data = gzip.compress(b"h\n" + inner + b"\nx\n", 0)  # stored, so the magic stands in the file
    (tmp_path / "d.gz").write_bytes(data)
    with pa.OSFile(str(tmp_path / "d.gz")) as f:
        blocks = [list(gzip_dump.lines(f, len(data), s, min(s + 500, len(data)))) for s in range(0, len(data), 500)]
    assert b"".join(blocks[0]) == b"h\n" + inner + b"\nx\n" and not any(blocks[1:])


def test_ten_members_are_read_by_ten_tasks(spark, tmp_path):
    body = made(2000)
    folder = tmp_path / "dump"
    folder.mkdir()
    text = HEADER + "".join(body)
    cuts = [len((HEADER + "".join(body[: 200 * k])).encode()) for k in range(1, 10)]
    size = write(str(folder / "a.gz"), text, cuts)
    write(str(folder / "b.gz"), HEADER, [])
    df = gzip_dump.read_gzip_dump(spark, str(folder), split_bytes=-(-size // 10))
    tasks = df.filter(F.col("tconst").isNotNull()).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) == 10 and sum(t["count"] for t in tasks) == 2000
    (tmp_path / "plain.tsv").write_text(text)
    plain = raw.read_dump(spark, str(tmp_path / "plain.tsv"))
    whole = raw.read_dump(spark, str(folder / "a.gz"))
    assert whole.columns == plain.columns and whole.exceptAll(plain).count() == 0 and plain.count() == whole.count()


def test_malformed_lines_are_kept_apart(spark, tmp_path):
    lines = ["a\tA\t1\t1\n", "short\tA\n", "b\tA\t1\t2\textra\n", 'c"\tA\t\\N\t\n', "\n", "d\tA\t1\t4\r\n"]
    write(str(tmp_path / "d.gz"), HEADER + "".join(lines), [50, 60])
    got = sorted(tuple(r) for r in raw.read_dump(spark, str(tmp_path / "d.gz")).collect())
    assert got == [("a", "A", "1", "1"), ('c"', "A", None, None), ("d", "A", "1", "4")]
    assert sorted(r["line"] for r in raw.malformed_lines(spark, str(tmp_path / "d.gz")).collect()) == ["b\tA\t1\t2\textra", "short\tA"]
    (tmp_path / "cut.gz").write_bytes((tmp_path / "d.gz").read_bytes()[:-12])
    with pytest.raises(Exception, match="cut off"):
        raw.read_dump(spark, str(tmp_path / "cut.gz")).collect()
    with pytest.raises(Exception, match="nothing-here"):
        raw.read_dump(spark, str(tmp_path / "nothing-here.gz")).collect()
