"""Property tests against brute force on small generated inputs."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators.dedupe import dedupe_first, duplicate_keys
from tidemark.operators.metrics import SeriesTrend
from tidemark.operators.order_stats import element_at_rank, grouped_quantiles

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

pairs = st.lists(st.tuples(st.integers(0, 6), st.sampled_from(["a", "b", "c", "d"])), min_size=1, max_size=60)


@SETTINGS
@given(data=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.sampled_from(["a", "b", "c", "d"])), min_size=1, max_size=60),
       fraction=st.sampled_from([0.0, 0.25, 0.5, 0.99]), rows_per_task=st.sampled_from([200_000, 2]))
def test_element_at_rank_is_sorted_index(spark, data, fraction, rows_per_task):
    """One range and many; NULLs sort last."""
    df = spark.createDataFrame(data, "w int, k string")
    got = element_at_rank(df, ["w", "k"], fraction, rows_per_task=rows_per_task).collect()
    want = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[math.floor(len(data) * fraction)]
    assert [(r["w"], r["k"]) for r in got] == [want]


@SETTINGS
@given(data=pairs)
def test_dedupe_first_and_duplicates(spark, data):
    df = spark.createDataFrame(data, "w int, k string")
    got = {r["k"]: r["w"] for r in dedupe_first(df, ["k"], ["w"]).collect()}
    want = {}
    for w, k in data:
        want[k] = min(w, want.get(k, w))
    assert got == want
    counts = {}
    for _, k in data:
        counts[k] = counts.get(k, 0) + 1
    assert {r["k"]: r["count"] for r in duplicate_keys(df, ["k"]).collect()} == {k: n for k, n in counts.items() if n > 1}


items = st.lists(
    st.tuples(st.sampled_from(["x", "y"]), st.integers(1, 5), st.integers(1, 10), st.integers(0, 4)),
    min_size=1, max_size=40,
)


def _brute(rows):
    """Reference computation of the trend outputs in plain Python."""
    out = {}
    for e in sorted({r[0] for r in rows}):
        periods = sorted({r[1] for r in rows if r[0] == e})
        wr = []
        for p in periods:
            g = [r for r in rows if r[0] == e and r[1] == p]
            sw = sum(r[3] for r in g)
            wr.append(sum(r[2] * r[3] for r in g) / sw if sw else None)
        vals = [v for v in wr if v is not None]
        base = sum(vals) / len(vals) if vals else None
        below, durable = [], 0
        for i in range(len(periods)):
            win = [v for v in wr[max(0, i - 2): i + 1] if v is not None]
            roll = sum(win) / len(win) if win else None
            below.append(1 if (roll is not None and base is not None and roll < base) else 0)
            durable += 1 if (roll is not None and base is not None and roll >= base) else 0
        brk = None
        for i in range(1, len(periods)):
            if below[i] and below[i - 1]:
                brk = periods[i] - 1
                break
        out[e] = (brk, durable)
    return out


@SETTINGS
@given(rows=items)
def test_break_and_durability_brute_force(spark, rows):
    data = [(f"i{n}", e, p, n, float(s), w) for n, (e, p, s, w) in enumerate(rows)]
    fact = spark.createDataFrame(data, "item_id string, entity_id string, period int, ordinal int, score double, weight bigint")
    t = SeriesTrend(fact)
    dim = fact.select("entity_id").distinct()
    got_b = {r["entity_id"]: r["break_period"] for r in t.break_period(dim).collect()}
    got_d = {r["entity_id"]: r["durability"] for r in t.durability(dim).collect()}
    want = _brute(rows)
    for e, (brk, dur) in want.items():
        # a float tie between rolling mean and baseline may flip '<' / '>='; any
        # disagreement must come with such a tie
        if got_b[e] != brk or got_d[e] != dur:
            assert_float_tie(t, e)


def assert_float_tie(t, e):
    from pyspark.sql import functions as F

    rows = t.frame.filter(F.col("entity_id") == e).collect()
    assert any(
        r["rolling_mean"] is not None and r["baseline"] is not None and abs(r["rolling_mean"] - r["baseline"]) < 1e-9
        for r in rows
    ), f"break mismatch for {e} without a float tie"


groups = st.lists(st.tuples(st.sampled_from(["g", "h", None]), st.integers(0, 9)), min_size=1, max_size=50)


def _interp(vals, q):
    vals = sorted(vals)
    pos = q * (len(vals) - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    return vals[lo] if lo == hi else (hi - pos) * vals[lo] + (pos - lo) * vals[hi]


@SETTINGS
@given(data=groups, rows_per_task=st.sampled_from([200_000, 2]))
def test_grouped_quantiles_one_range_and_many(spark, data, rows_per_task):
    df = spark.createDataFrame([(g, float(v)) for g, v in data], "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    got = {r["g"]: r for r in grouped_quantiles(df, ["g"], "v", probs, names, rows_per_task).collect()}
    assert set(got) == {g for g, _ in data}
    for g in {g for g, _ in data}:
        vals = [float(v) for gg, v in data if gg == g]
        for name, q in zip(names, probs):
            assert math.isclose(got[g][name], _interp(vals, q), abs_tol=1e-9)


from tidemark.operators import ingest  # noqa: E402

texts = st.sampled_from([None, "0", "1", "2", "x1"])
item_rows = st.lists(st.tuples(st.sampled_from(["i1", "i2", "i3", "i4"]), st.sampled_from(["A", "B", None]),
                               texts, texts), min_size=1, max_size=12)
rating_rows = st.lists(st.tuples(st.sampled_from(["i1", "i2", "i3", "i4"]),
                                 st.sampled_from([None, 5.0, 7.0]), st.sampled_from([None, 0, 3])), max_size=8)
type_rows = st.lists(st.tuples(st.sampled_from(["i1", "i2", "i3", "i4"]),
                               st.sampled_from([None, "tvEpisode", "tvSpecial"])), max_size=8)


def _expected(item, parent, period, ordinal, ratings, types, selected):
    """(score, weight, reason) rows of one item row: one, or one per matching rating."""
    def to_int(t):
        try:
            return int(t)
        except (TypeError, ValueError):
            return None

    def first(rules):
        return next((name for name, failed in rules if failed), None)

    reason = first([
        ("not_selected", parent not in selected),
        ("period_null", period is None),
        ("period_invalid", to_int(period) is None),
        ("period_zero", to_int(period) == 0),
        ("ordinal_null", ordinal is None),
        ("ordinal_invalid", to_int(ordinal) is None),
    ])
    if reason:
        return [(None, None, reason)]
    ts = [t for i, t in types if i == item and t is not None]
    first_type = min(ts) if ts else None
    return [(s, w, first([
        ("score_null", s is None),
        ("weight_null", w is None),
        ("type_missing", first_type is None),
        ("type_wrong", first_type != "tvEpisode"),
    ])) for i, s, w in ratings if i == item and item is not None] or [(None, None, "unrated")]


@SETTINGS
@given(items_=item_rows, ratings=rating_rows, types=type_rows, selected=st.sampled_from([{"A"}, {"A", "B"}, set()]))
def test_reject_rules_brute_force(spark, items_, ratings, types, selected):
    items = spark.createDataFrame(items_, "item_id string, parent_id string, period_text string, ordinal_text string")
    r = spark.createDataFrame(ratings, "item_id string, score double, weight bigint")
    t = spark.createDataFrame(types, "item_id string, item_type string")
    sel = spark.createDataFrame([(x,) for x in sorted(selected)], "entity_id string")
    rules = ingest.CleanRules(min_part_rows=1)  # every repeated id counts as hot
    cols = ("item_id", "score", "weight", "reject_reason")
    got = sorted((tuple(row[c] for c in cols) for row in ingest.tag_items(items, r, t, sel, rules, selected_rows=len(selected)).collect()),
                 key=str)  # reasons mix None and text
    want = sorted(((i, *x) for i, p, pt, ot in items_ for x in _expected(i, p, pt, ot, ratings, types, selected)), key=str)
    assert got == want


from tidemark.operators.joins import SALTS_COLUMN, attach  # noqa: E402

big_rows = st.lists(st.tuples(st.sampled_from(["h", "h", "h", "a", "b", None]), st.integers(0, 50)),
                    min_size=1, max_size=60)
table_rows = st.lists(st.tuples(st.sampled_from(["h", "a", "c", None]), st.integers(0, 3)), max_size=6)


@SETTINGS
@given(big=big_rows, table=table_rows, how=st.sampled_from(["inner", "left", "left_semi", "left_anti"]))
def test_salted_attach_equals_plain_join(spark, big, table, how):
    b = spark.createDataFrame(big, "k string, v int")
    t = spark.createDataFrame(table, "k string, w int")
    hot = spark.createDataFrame([("h", 4)], f"k string, {SALTS_COLUMN} int")
    salted = attach(b, t, ["k"], how, table_rows=None, hot_keys=hot, salt_by=["v"])
    plain = b.join(t, ["k"], how)
    assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
