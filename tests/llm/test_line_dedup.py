"""Line de-duplication against a dictionary count and against its SQL."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from tidemark.llm import line_dedup, registry

WHITE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UPPER = {v: k for k, v in LOWER.items()}


def brute(rows, min_chars=40, min_documents=5):
    """[(doc_id, n_lines, n_dropped, kept text)] of (doc_id, text) rows."""
    key = lambda line: line.strip(WHITE).translate(LOWER)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and doc is not None:
                holders[key(line)].add(doc)
    common = {k: max(v) for k, v in holders.items() if len(v) >= min_documents}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in common or common[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def made(seed, n=150):
    rng = random.Random(seed)
    shared = [f"Shared line number {i} " + "é" * rng.randrange(15, 25) for i in range(12)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(0, 9)):
            line = rng.choice([*shared, f"own {rng.random()} " * 3, "short", ""])
            lines.append(rng.choice(["", " ", "\t\r", "\x0b "]) + rng.choice([line, line, line.translate(UPPER), line.upper()]) + rng.choice(["", "\f "]))
        rows.append((i if i % 11 else i // 2, "\n".join(lines)))
    return [*rows, (None, None), (None, shared[0]), (None, shared[0]), (7, ""), (3, None), (rows[5][0], rows[5][1]), (901, "\n".join(shared * 400))]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = line_dedup.drop_common_lines(df).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))
    assert sum(r["n_dropped"] for r in got) > 100


def test_query_and_sql_agree_on_edge_cases(spark, tmp_path):
    rows = made(3)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op12_line_dedup"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.sql(registry.ORACLE["op12_line_dedup"])
    want = [(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in brute(rows)]
    columns = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert tuple(sql.columns) == columns
    assert sorted(map(repr, want)) == sorted(map(repr, sql.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in got)


def test_empty_table_other_limits_and_clashing_columns(spark):
    schema = "doc_id long, text string, n_lines string, _lm_at int, _line int"
    assert line_dedup.drop_common_lines(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "aB\nx", "z", 1, 1), (2, " Ab ", "z", 2, None)]
    got = line_dedup.drop_common_lines(spark.createDataFrame(rows, schema), min_chars=2, min_documents=2)
    assert got.columns == ["doc_id", "text", "n_lines", "_lm_at", "_line", "n_dropped"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x", 2, 1, 1, 1), (2, " Ab ", 1, 2, None, 0)]


def test_main_path_is_native(spark):
    df = spark.createDataFrame(made(4), "doc_id long, text string")
    plan = line_dedup.drop_common_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
