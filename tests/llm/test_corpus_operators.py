"""Decontamination, language model, near-duplicates, vectors, WARC and the pipeline."""

import hashlib
import base64
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import cap_filters, components, decontaminate, elias_fano, minhash, ngram_trie, packing, registry, warc
from tidemark.llm.shared import shared_path, string_buffer
from tidemark.llm.words import word_hashes

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 9))) for _ in range(400)]


def prose(n, rng):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def components_of(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(300)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == components_of({x for e in real for x in e}, real)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_exact_distance_is_the_best_window():
    rng = np.random.default_rng(3)
    for _ in range(30):
        text, item = rng.integers(0, 4, 25).astype(np.uint64), rng.integers(0, 4, 8).astype(np.uint64)
        at = np.arange(25)
        got, end = decontaminate.distances(text, at, np.full(25, 25), np.tile(item, (25, 1)), 3)
        for s in at:
            best = min([8] + [edit_distance(item, text[s:e]) for e in range(s, min(25, s + 11) + 1)])
            assert got[s] == best and edit_distance(item, text[s : end[s]]) == best


def test_leaks(spark):
    rng = random.Random(8)
    items = [(i, prose(rng.randrange(15, 50), rng)) for i in range(40)] + [(90, "too few words"), (None, prose(30, rng)), (91, None)]
    docs, planted = [], {}
    for d in range(160):
        text = prose(200, rng)
        if d % 2:
            i, item = items[d % 40]
            words = item.split()
            for _ in range(int(len(words) * 0.2) * (d % 4 == 1)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = ["new" + str(rng.randrange(9))] if rng.random() < 0.7 else []
            if edit_distance(words, item.split()) <= int(len(item.split()) * 0.2):
                planted[d] = i
            text = text + ", " + (" ".join(words)).upper() + "! " + prose(20, rng)
        docs.append((d, text, "x"))
    docs += [(500, None, "x"), (None, items[3][1], "x"), (None, items[3][1], "x")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, _lm_normal string"), spark.createDataFrame(items, "item_id long, text string")
    for per_block in (20_000, 10):
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(df, bench, per_block=per_block).collect()}
        found = {d for d, _ in got}
        assert len([d for d in planted if (d, planted[d]) in got]) >= 0.97 * len(planted)
        assert all(d is None or d % 2 for d in found) and (None, 3) in got
    kept = decontaminate.drop_leaking(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, *_ in docs} - found
    assert decontaminate.find_leaks(df, bench.where("item_id = -1")).collect() == []


def test_items_beyond_the_tables_are_searched_without_loss():
    rng = np.random.default_rng(6)
    for _ in range(20):  # few different words: many hits that are no occurrence
        words = [rng.integers(1, 4, 12).astype(np.uint64), rng.integers(1, 4, 17).astype(np.uint64)]
        texts = [rng.integers(1, 4, n).astype(np.uint64) for n in (40, 3, 25)]
        index = decontaminate.build_index([0, 1], words, decontaminate.Search(recall=1.1))
        assert not index.classes
        got = decontaminate.matches(np.concatenate(texts), np.repeat(np.arange(3), [40, 3, 25]), index)
        want = []
        for r, text in enumerate(texts):
            for i, item in enumerate(words):
                k = int(decontaminate.allowed_edits(len(item), 0.8))
                at = np.arange(len(text))
                d, end = decontaminate.distances(text, at, np.full(len(text), len(text)), np.tile(item, (len(text), 1)), k)
                best = min(zip(d.tolist(), at.tolist(), end.tolist()))
                want += [(r, i, *best)] * (best[0] <= k)
        assert got == want
    # long items with all edits allowed, in texts of their own vocabulary
    words = [rng.integers(1, 3000, n).astype(np.uint64) for n in (30, 400, 900)]
    index = decontaminate.build_index([7, 8, 9], words, decontaminate.Search(max_tables=20))
    edited = [decontaminate._edited(w, len(w) // 5, rng) for _ in range(8) for w in words[1:]]
    texts = [np.concatenate([rng.integers(1, 3000, 100).astype(np.uint64), e, rng.integers(1, 3000, 100).astype(np.uint64)]) for e in edited]
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = decontaminate.matches(np.concatenate(texts), rows, index)
    assert [g[:2] for g in got] == [(r, 1 + r % 2) for r in range(len(texts))]


def test_each_length_class_decides_on_its_own():
    rng = np.random.default_rng(2)
    groups = [[rng.integers(1, 2**62, n).astype(np.uint64) for n in rng.integers(low, high + 1, 40)] for low, high in ((5, 7), (12, 17), (27, 40), (62, 92))]
    walks = lambda index: {int(i) for c in index.classes for i in c.items[0]}
    alone = [len(walks(decontaminate.build_index(list(range(40)), g, decontaminate.Search()))) for g in groups]
    words = [w for g in groups for w in g]
    index = decontaminate.build_index(list(range(160)), words, decontaminate.Search())
    assert walks(index) == {40 * k + i for k, n in enumerate(alone) for i in range(n)}
    missed = alone.index(0)
    assert any(alone[missed + 1 :])  # a class that misses the recall doesn't take longer items off the walks
    texts = [np.concatenate([rng.integers(1, 2**62, 50).astype(np.uint64), w, rng.integers(1, 2**62, 50).astype(np.uint64)]) for w in words]
    got = decontaminate.matches(np.concatenate(texts), np.repeat(np.arange(160), [len(t) for t in texts]), index)
    assert [g[:3] for g in got] == [(i, i, 0) for i in range(160)]


def test_short_items_and_unspaced_scripts(spark):
    items = [(1, "Treaty of Utrecht"), (2, "quux"), (3, "长江是亚洲最长的河流,全长约六千三百公里。"), (4, "東京タワーは一九五八年に建てられました"), (5, "กรุงเทพมหานครเป็นเมืองหลวง"), (6, "!?"), (7, "大象")]
    docs = [(1, "After the treaty (of) UTRECHT, peace."), (2, "treaty at Utrecht; quuxes"), (3, "a Quux."), (4, "我们知道:长江是亚洲最长的河流,全长约六千三百公里!大家都知道。"),
            (5, "昔、東京タワーは一九五八年に作られました。"), (6, "ว่ากรุงเทพมหานครเป็นเมืองหลวงของ"), (7, "黄河是中国第二长的河流。"), (8, "看大象吧"), (9, "quux quux treaty of utrecht"), (10, "!?"), (11, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(df, bench).collect()}
    assert sorted(got) == [(1, 1), (3, 2), (4, 3), (5, 4), (6, 5), (8, 7), (9, 1), (9, 2)]
    assert got[4, 3]["distance"] == 0 and got[4, 3]["first_word"] == 4 and 0 < got[5, 4]["distance"] <= 3
    assert (got[9, 2]["first_word"], got[9, 2]["end_word"], got[9, 2]["item_words"], got[9, 1]["first_word"]) == (0, 1, 1, 2)
    assert {r["doc_id"] for r in decontaminate.drop_leaking(df, bench).collect()} == {2, 7, 10, 11}


def test_elias_fano_sequence():
    rng = np.random.default_rng(5)
    for n, universe in ((0, 10), (1, 1), (50, 60), (5000, 1 << 44), (3000, 1 << 63)):
        values = np.sort(rng.integers(0, universe, n, dtype=np.uint64, endpoint=False))
        s = elias_fano.Sequence(np.frombuffer(elias_fano.pack(values, universe) + b"tail", np.uint8))
        assert (s.access(np.arange(n)) == values).all()
        asked = np.concatenate([values, rng.integers(0, universe, 200, dtype=np.uint64, endpoint=False)])
        assert (s.successor(asked) == np.searchsorted(values, asked)).all()
        assert ((s.find(asked) >= 0) == np.isin(asked, values)).all()


def test_language_model(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=rng.randrange(60))) for _ in range(250)] + [None, "", "ONE\u00a0é", "word " * 4000]
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[7]), (None, "one two")], "doc_id long, text string").repartition(3)
    got = ngram_trie.score_corpus(docs, F.col("doc_id") % 4 == 1, chunk_tokens=700).collect()
    assert len(got) == len(texts) + 2
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]
    rows = [(i, split(t), i % 4 == 1) for i, t in enumerate(texts)] + [(7, split(texts[7]), False), (None, split("one two"), False)]
    c, b = Counter(), Counter()
    for _, t, held in rows:
        if not held:
            c.update(t)
            b.update(zip([0, *t], t))
    n, v = sum(c.values()), len(c)
    followers, total = Counter(), Counter()
    for (x, _), k in b.items():
        followers[x] += 1
        total[x] += k
    by_id = {r["doc_id"]: r for r in got}
    for i, t, held in rows:
        r = by_id[i]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(base)
        bounds = []
        for d in (0.1, 0.95):  # the discount of a group lies between these
            p = [(max(b[x, w] - d, 0) / total[x] if total[x] else 0) + (d * followers[x] / total[x] if total[x] else 1) * (c[w] + 1) / (n + v + 1) for x, w in zip([0, *t], t)]
            bounds.append([math.log10(q) for q in p])
        low, high = (sum(f(x) for x in zip(*bounds)) for f in (min, max))
        assert low - 0.01 * len(t) <= r["score"] <= high + 0.01 * len(t)
    assert sum(by_id[i]["score"] for i, _, h in rows if not h) > sum(by_id[i]["base_score"] for i, _, h in rows if not h)
    assert ngram_trie.score_corpus(docs.where("doc_id = -1"), F.lit(False)).collect() == []
    assert {r["train_tokens"] for r in ngram_trie.score_corpus(docs, F.lit(True)).collect()} == {0}


def test_near_duplicates(spark):
    rng = random.Random(7)
    base = [prose(120, rng) for _ in range(30)]
    docs = [(i, t) for i, t in enumerate(base)]
    for i in range(30, 60):
        words = base[i - 30].split()
        words[rng.randrange(len(words))] = "changed"
        docs.append((i, " ".join(words)))
    docs += [(100 + i, base[0]) for i in range(40)] + [(200, None), (201, ""), (202, "two words"), (203, "two words"), (None, base[1]), (5, base[5])]
    docs += [(300 + i, " ".join(base[2].split()[:30]) + " " + prose(90, rng)) for i in range(5)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").withColumn("k0", F.lit(1))).collect()
    assert len(got) == len(docs)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for i, t in docs if i is not None}
    text = {i: t or "" for i, t in docs if i is not None}
    ids = sorted(sets)
    jaccard = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    edges = [(a, b) for a in ids for b in ids if a < b and (text[a] == text[b] or jaccard(a, b) >= 0.8)]
    want = components_of(ids, edges)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["class_id"]) for r in got)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_consistent_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    ids = np.sort(rng.choice(1 << 40, 300, replace=False)).astype(np.uint64)
    wa, wb = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    bands = minhash.Bands(bands=1500, rows=1)
    _, keys = minhash.signatures(np.repeat([0, 1], 300), np.r_[ids, ids], np.r_[wa, wb], 2, bands)
    assert (keys[0] == keys[1]).mean() == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.04)


def test_open_buckets_connect_what_all_pairs_connect(spark):
    rng = random.Random(9)
    chain = [prose(100, rng).split()]
    for _ in range(40):  # each close to the last one only
        words = list(chain[-1])
        for _ in range(2):
            words[rng.randrange(100)] = "w" + str(rng.randrange(10**6))
        chain.append(words)
    rng.shuffle(chain)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(chain)], "doc long, text string")
    model = spark.sparkContext.broadcast(minhash.Frequent(np.empty(0, np.uint64), np.empty(0)))
    open_ = docs.select(F.lit(5).cast("long").alias("bucket"), F.col("doc").alias("rep"), F.col("doc").alias("component"))
    sets = {i: {tuple(w[k : k + 5]) for k in range(96)} for i, w in enumerate(chain)}
    edges = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    for block in (256, 7):
        links = [tuple(r) for r in minhash.compare_buckets(open_, docs, model, minhash.Bands(), block=block).collect()]
        assert components_of(sets, links) == components_of(sets, edges)


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 24))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 20] * 3 + 0.1 * rng.standard_normal(24)).tolist(), int(i % 20 % 3)) for i in range(80)]
    rows += [(300 + i, base[0].tolist(), 0) for i in range(30)] + [(400, base[0].tolist(), None), (401, base[0].tolist(), 1)]
    bad = [(500, None), (501, []), (502, [0.0] * 24), (503, [float("nan")] * 24), (504, [None] * 24), (505, [float("inf")] + [1.0] * 23), (506, [1.0])]
    rows += [(i, v, 0) for i, v in bad]
    got = {r["vec_id"]: r for r in cap_filters.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=16).collect()}
    use = [(i, np.array(v) / np.linalg.norm(v), l) for i, v, l in rows if l is not None and i < 500]
    edges = [(a, b) for a, x, k in use for b, y, l in use if a < b and k == l and float(x @ y) >= 0.98]
    label, degree = components_of([i for i, *_ in rows], edges), Counter(x for e in edges for x in e)
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (degree[i], label[i], label[i] == i)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert cap_filters.link_vectors(empty).collect() == []


def test_a_group_of_near_copies_sends_rows_not_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.03 * rng.standard_normal(16)).tolist(), 1) for i in range(300)]
    staged, stage = {}, cap_filters.stage
    monkeypatch.setattr(cap_filters, "stage", lambda df, label: staged.setdefault(label, stage(df, label)))
    got = {r["vec_id"]: r for r in cap_filters.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    assert [got[i]["n_links"] for i in range(300)] == (near.sum(1) - 1).tolist() and near.sum() > 40_000
    assert staged["links"].count() <= staged["caps"].count() < near.sum() / 4
    assert {r["component_id"] for r in got.values()} == {0}


def test_pairs_count_in_their_first_shared_filter():
    rng = np.random.default_rng(2)
    sets = [sorted(rng.choice(12, rng.integers(1, 5), replace=False).tolist()) for _ in range(40)]
    filters = cap_filters._padded(pa.array(sets, pa.list_(pa.int64())))
    seen = Counter()
    for place in range(12):
        here = [i for i, x in enumerate(sets) if place in x]
        a, b = (np.array(x, np.int64) for x in zip(*[(i, j) for i in here for j in here if i < j]))
        first = cap_filters._first_shared(a, b, filters, place)
        seen.update(zip(a[first].tolist(), b[first].tolist()))
    assert seen == Counter((i, j) for i in range(40) for j in range(i + 1, 40) if set(sets[i]) & set(sets[j]))


def test_lowest_node_reached():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 200, (2, 130))
    label = components_of(range(200), list(zip(a.tolist(), b.tolist())))
    assert cap_filters._lowest_reached(a, b, 200).tolist() == [label[i] for i in range(200)]


def test_list_decoding_finds_all_filters_above_the_cap():
    code = cap_filters.CapCode(codes=1, blocks=3, words=6, lists=8)
    unit = np.random.default_rng(1).standard_normal((50, 20))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turn, words = cap_filters.codebook(20, code, 0)
    turned = (unit @ turn).reshape(50, 3, -1)
    s = np.einsum("nbw,bcw->nbc", turned, words)
    full = (s[:, 0, :, None, None] + s[:, 1, None, :, None] + s[:, 2, None, None, :]).reshape(50, -1)
    row, found = cap_filters.decode(unit, code, 0)
    got = set(zip(row.tolist(), found.tolist()))
    want = {(int(i), int(j)) for i, j in np.argwhere(full >= code.cap(20))}
    alone = {(i, int(full[i].argmax())) for i in range(50) if not (full[i] >= code.cap(20)).any()}
    assert got == want | alone


def test_warc_round_trip(spark):
    rng = random.Random(5)
    rows = [(i, f"http://x/{i}?é %\n", prose(rng.randrange(1, 300), rng)) for i in range(120)]
    rows += [(200 + i, None, "same") for i in range(40)] + [(300, "u", None), (301, "u", ""), (None, "u", "same"), (None, "v", "own")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    for split in (997, 1 << 20):
        got = warc.archive_round_trip(df, split_bytes=split).collect()
        assert Counter((r["page_id"], r["url"], bytes(r["payload"])) for r in got if r["record_type"] == "response") == Counter(
            (i, u, (h or "").encode()) for i, u, h in rows if i is None and h == "own" or i is not None and (i < 200 or i in (239, 301)))
        for r in got:
            assert len(r["payload_digest"]) == 32 and (r["refers_to"] is not None) == (r["record_type"] == "revisit")
        revisit = {r["page_id"]: r for r in got if r["record_type"] == "revisit"}
        assert revisit[205]["refers_to"] == 239 and revisit[300]["refers_to"] == 301 and revisit[None]["payload_bytes"] == 4
        assert revisit[205]["payload_digest"] == base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    assert not [r for r in warc.archive_round_trip(df, min_bytes=5).collect() if r["record_type"] == "revisit"]
    assert warc.archive_round_trip(df.where("page_id = -1")).collect() == []


def test_every_split_owns_each_record_once(spark, tmp_path):
    data = b"".join(warc.record_bytes(i, "u", b"\x1f\x8b\x08 not a member " * (i % 5) + bytes([i]) * i, None, False, "d") for i in range(30)) + b"\x1f\x8b\x08 junk"
    (tmp_path / "a").write_bytes(data)
    with pa.OSFile(str(tmp_path / "a")) as f:
        whole = list(warc.scan(f, len(data), 0, len(data)))
        assert len(whole) == 30
        for step in (1, 7, 100, 1000, len(data)):
            assert [x for s in range(0, len(data), step) for x in warc.scan(f, len(data), s, min(s + step, len(data)))] == whole


def test_damaged_archives_are_errors(spark, tmp_path):
    records = [warc.record_bytes(i, "u", bytes([65 + i]) * 500 + RNG.randbytes(300), None, False, "d") for i in range(5)]
    data = b"".join(records)
    broken = bytearray(data)
    broken[len(data) - len(records[-1]) // 2] ^= 255
    for name, content in (("cut", data[:-9]), ("broken", bytes(broken))):
        (tmp_path / name).write_bytes(content)
        with pa.OSFile(str(tmp_path / name)) as f, pytest.raises(ValueError, match="cut off|damaged"):
            list(warc.scan(f, len(content), 0, len(content)))
    df = spark.createDataFrame([(i, "u", "text %d" % i) for i in range(20)], "page_id long, url string, html string")
    path = shared_path(spark, "warc-test")
    manifest = warc.write_archives(warc.with_revisits(df, 0), path)
    longer = manifest.withColumn("bytes", F.col("bytes") + 1)
    with pytest.raises(Exception, match="manifest says"):
        warc.read_archives(spark, path, longer).collect()
    assert warc.read_archives(spark, path, manifest).count() == 20


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    item = prose(30, rng)
    texts = [prose(60, rng) + ". " + prose(30, rng) + "." for _ in range(60)]
    bad = [" ".join(w + "$$$" for w in prose(60, rng).split()) for _ in range(30)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts + bad)]
    extra = [texts[3], prose(50, rng) + ". " + item + ". " + prose(20, rng) + ".", prose(60, rng) + ". Mail a.b@c.com now. " + prose(40, rng) + "."]
    docs += [(200 + i, t, None, None, None) for i, t in enumerate(extra)] + [(300, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES[:-1]:
        frame = function(spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({r["doc_id"]: r["text"] for r in frame.collect()})
    good = set(range(60)) | {200, 201, 202}
    assert set(seen[0]) - {300} == good and set(seen[1]) - {300} == good - {200} and set(seen[2]) - {300} == good - {200, 201}
    assert seen[3][202] == extra[2].replace("a.b@c.com", "<email>") and all(seen[3][i] == texts[i] for i in range(60))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = packing.encoder(registry.TOKENIZER)
    assert sum(r["length"] for r in out) == sum(len(encode(t or "")) + 1 for t in seen[3].values())


@pytest.mark.parametrize("share", [0, 0.05, 0.5, 1])
def test_the_quality_stage_keeps_what_op9_predicts_good(spark, tmp_path, share):
    rng = random.Random(5)
    bad = [" ".join(w + "$$$" * (i % 4 > 0) for w in prose(20 + i % 40, rng).split()) for i in range(60)]
    texts = [prose(60, rng) + ". " + prose(30, rng) + "." for _ in range(60)] + bad
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(500, None, "en", "s", 0), (None, texts[0], "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 60 or i % 40 >= 40 * share)) if share < 1 else (i, 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [r["doc_id"] for r in corpus_pipeline.good_quality(spark, registry.table(spark, str(tmp_path), "documents"), str(tmp_path)).collect()]
    good = [r["doc_id"] for r in registry.op9_quality_ranker(spark, str(tmp_path)).where("predicted = 1").collect()]
    assert Counter(kept) == Counter(good) and (share > 0 or len(kept) == len(docs)) and (share < 1 or not kept)


def test_shingles_of_short_texts():
    row, ids, tf = minhash.shingles(*string_buffer(pa.array(["", "a b", "a b", "a b c d e f", "x x x x x x x"])), 5)
    assert row.tolist() == [1, 2, 3, 3, 4] and ids[0] == ids[1] and tf.tolist() == [1, 1, 1, 1, 3]
    assert len(word_hashes(*string_buffer(pa.array([], pa.string())))[0]) == 0
