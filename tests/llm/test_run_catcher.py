"""Periodic runs against brute force, whatever the pieces; the query's digest on whole rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import registry, run_catcher


def brute_runs(words, min_length=6, copies=4):
    """Maximal stretches of every period, those whose smallest period is a smaller one left out."""
    n, out = len(words), []
    for p in range(1, n // copies + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            stretch = words[i : j + p]
            if len(stretch) >= max(min_length, copies * p) and not any(stretch[q:] == stretch[:-q] for q in range(1, p)):
                out.append((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def caught(words, pieces, **limits):
    catcher = run_catcher.RunCatcher(**limits)
    at = 0
    for size in pieces:
        catcher.append(np.array(words[at : at + size], np.int64))
        at += size
    catcher.append(np.array(words[at:], np.int64))
    return catcher.runs()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.lists(st.integers(0, 9), max_size=40))
def test_small_alphabets_in_any_pieces(words, pieces):
    assert caught(words, pieces) == brute_runs(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 40)), max_size=7), st.lists(st.integers(0, 60), max_size=20),
       st.integers(2, 5), st.integers(1, 12))
def test_nested_repeats_and_other_limits(parts, pieces, copies, shortest):
    words = [w for root, times in parts for w in (root * times)[:60]]
    assert caught(words, pieces, min_copies=copies, min_length=shortest) == brute_runs(words, shortest, copies)


def test_every_word_appended_alone_and_long_periods():
    rng = random.Random(3)
    words = [rng.randrange(50) for _ in range(30)]
    for p in (1, 2, 3, 6, 7, 14, 15, 31, 64, 127):
        root = [rng.randrange(1000) for _ in range(p)]
        words += (root * 9)[: rng.randrange(4 * p - 1, 6 * p + 3)] + [2000 + p]
    want = brute_runs(words)
    assert len(want) >= 8
    assert caught(words, [1] * len(words)) == caught(words, []) == caught(words, [100, 1, 1000]) == want


def test_one_word_a_million_times_and_a_power_of_words():
    assert caught([5] * 300_000, [99_999, 7]) == [(0, 300_000, 1)]
    root = list(range(997))
    assert caught(root * 200, [10_000] * 5) == [(0, 997 * 200, 997)]


def query_brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {
        "doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
        "exponent_milli": 1000 * best[1] // best[2] if runs else None,
        "runs_sha256": sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)),
        "collapsed_sha256": sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    }


def made(seed):
    rng = random.Random(seed)
    rows = [(None, None), (None, "a a a a a a a"), (3, ""), (4, " \t\n"), (5, "é x é x"), (5, "é x é x"), (-10, "x" * 50_000), (6, "b\x1cc " * 40)]
    for i in range(250):
        words = [rng.choice(["the", "of", "a", "é", "w%d" % rng.randrange(90)]) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            at, root = rng.randrange(len(words) + 1), ["r%d" % rng.randrange(5) for _ in range(rng.randrange(1, 9))]
            words[at:at] = (root * 12)[: rng.randrange(1, 12 * len(root))]
        rows.append((i * 37, rng.choice(["", " "]) + rng.choice([" ", "\n", "\t \r\x0b"]).join(words)))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_query_against_brute_force(spark, tmp_path, parts):
    rows = made(parts)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in registry.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()]
    want = [query_brute(*r) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(r["n_runs"] > 0 for r in want) > 60 and any(r["n_runs"] > 2 for r in want)


def test_frame_cases(spark):
    schema = "n_words string, TEXT string, _lm_text int, doc_id long"
    assert run_catcher.find_runs(spark.createDataFrame([], schema)).collect() == []
    rows = [("x", "b b b b b b b c " * 2, 1, 1), (None, None, None, None)]
    got = run_catcher.find_runs(spark.createDataFrame(rows, schema), keep_text=True).collect()
    assert got[0].asDict(True) == {
        "TEXT": rows[0][1], "_lm_text": 1, "doc_id": 1, "n_words": 16, "collapsed": "b c b c",
        "runs": [{"start": 0, "length": 7, "period": 1}, {"start": 8, "length": 7, "period": 1}],
    }
    assert (got[1]["n_words"], got[1]["runs"], got[1]["collapsed"]) == (0, [], "")
