"""Check states of batches add up to the checks of their union."""

import os
import random
import shutil

import pytest

from tidemark.operators import quality
from tidemark.operators.check_state import add_batch, merged_checks

ITEMS = "item_id string, entity_id string, period int, ordinal int, score double, weight bigint"
META = "entity_id string, title string, start_year int, end_year int, genres string"
TYPES = "item_id string, item_type string"
RULES = quality.QualityRules(valid_types=("ok",), id_prefix="i")


def _batches(seed, n=3):
    """Batches whose ids repeat inside and across them, with NULLs, bad scores and unknown entities."""
    rnd = random.Random(seed)
    out = []
    for b in range(n):
        items = [(rnd.choice([None, "hot", f"i{rnd.randrange(40)}", f"i{b}-{k}"]), rnd.choice([None, "A", "B", "X"]), rnd.choice([None, 0, 1, 2]),
                  rnd.choice([None, 1]), rnd.choice([None, 0.5, 7.0, 11.0]), rnd.choice([None, -1, 5])) for k in range(60)]
        types = [(rnd.choice([None, "hot", f"i{rnd.randrange(40)}"]), rnd.choice(["ok", "other", None])) for _ in range(30)]
        meta = [(rnd.choice(["A", "B", "C", None]), "t", 1, None, "g") for _ in range(b)]
        out.append((items, meta, types))
    return out


def _frames(spark, batch):
    return [spark.createDataFrame(rows, schema) for rows, schema in zip(batch, (ITEMS, META, TYPES))]


def _expected(spark):
    return spark.createDataFrame([("A",), ("B",), ("D",)], "entity_id string")


def _rows(df):
    return {r["check_id"]: (r["check_name"], r["status"], r["observed"]) for r in df.collect()}


def _whole(spark, batches):
    return _rows(quality.item_checks(*_frames(spark, [sum((b[i] for b in batches), []) for i in range(3)]), _expected(spark), RULES))


def test_merged_states_equal_checks_of_the_union(spark, tmp_path):
    path, batches = f"{tmp_path}/state", _batches(1)
    for i, batch in enumerate(batches):
        add_batch(path, f"b{i}", *_frames(spark, batch), RULES)
        assert _rows(merged_checks(spark, path, _expected(spark), RULES)) == _whole(spark, batches[: i + 1])


def test_a_repeated_batch_replaces_itself_and_a_dead_one_is_left_out(spark, tmp_path):
    path, batches = f"{tmp_path}/state", _batches(2, 2)
    add_batch(path, "b0", *_frames(spark, batches[0]), RULES)
    for _ in range(2):
        add_batch(path, "b1", *_frames(spark, batches[1]), RULES)
    assert _rows(merged_checks(spark, path, _expected(spark), RULES)) == _whole(spark, batches)
    corrected = _batches(3, 1)[0]
    add_batch(path, "b1", *_frames(spark, corrected), RULES)
    assert _rows(merged_checks(spark, path, _expected(spark), RULES)) == _whole(spark, [batches[0], corrected])
    os.makedirs(f"{path}/b2/_versions/0000000001-dead")
    assert _rows(merged_checks(spark, path, _expected(spark), RULES)) == _whole(spark, [batches[0], corrected])


def test_earlier_batches_are_not_read_again(spark, tmp_path):
    path, batches = f"{tmp_path}/state", _batches(4, 2)
    for i, batch in enumerate(batches):
        folder = f"{tmp_path}/in{i}"
        frames = _frames(spark, batch)
        for name, df in zip("imt", frames):
            df.write.parquet(f"{folder}/{name}")
        add_batch(path, str(i), *[spark.read.parquet(f"{folder}/{name}") for name in "imt"], RULES)
        shutil.rmtree(folder)
    merged = merged_checks(spark, path, _expected(spark), RULES)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/in" not in plan and "Join" not in plan
    assert _rows(merged) == _whole(spark, batches)


def test_empty_batches_and_missing_columns(spark, tmp_path):
    path = f"{tmp_path}/state"
    with pytest.raises(FileNotFoundError):
        merged_checks(spark, path, _expected(spark), RULES)
    add_batch(path, "none", *_frames(spark, ([], [], [])), RULES)
    assert _rows(merged_checks(spark, path, _expected(spark), RULES)) == _whole(spark, [([], [], [])])
    items, meta, types = _frames(spark, _batches(5, 1)[0])
    add_batch(path, "short", items, meta.drop("genres"), types, RULES)
    assert _rows(merged_checks(spark, path, _expected(spark), RULES))["Q1b"][1:] == ("FAIL", 1)
