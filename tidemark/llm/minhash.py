"""Near-duplicate documents by improved consistent weighted sampling.

A document is its set of shingles (five words) with weights ``(1 + ln tf) * idf``.
The idf lies in [0.8, 1]: it falls with the share of documents that hold the
shingle, and shingles in fewer than one of ``RARE`` documents have the full weight
(so copies in a large group, whose common shingles are frequent, still come close
to the similarity which their texts have). Exact document counts of all shingles
are taken over the whole corpus; only the frequent ones matter, and at most
``RARE`` times the mean number of shingles of a document can be frequent, at any
size, so that list is broadcast.

``bands * rows`` consistent weighted samples (Ioffe's construction) make the band
keys. In each bucket the members are compared with the smallest one; where that leaves
several components in a bucket, members of different components are compared with
each other in blocks. So every candidate pair is either verified or already
connected, and no pairs are emitted but links.
Comparison is by the weighted Jaccard similarity of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import slices, spread_join, stage, string_buffer, text_or_empty
from tidemark.llm.words import mix, word_hashes

RARE = 1000
SLICE_BYTES = 4 << 20
GATHER = 2_000_000  # shingles that a counting task gathers before it sends them on
SIGN_BLOCK = 128_000  # shingles that one step of the sampling handles at a time
SHARD_BYTES = 24 << 20  # text whose shingles one counting group gets


class Bands(NamedTuple):
    """At similarity 0.8 ten bands of three find a pair with a probability of 0.9992."""

    bands: int = 10
    rows: int = 3
    words: int = 5
    threshold: float = 0.8
    seed: int = 11


class Frequent(NamedTuple):
    """Sorted ids of the frequent shingles, their idf, and nothing else."""

    ids: np.ndarray
    idf: np.ndarray

    def weights(self, ids: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = 1 + np.log(tf)
        if len(self.ids):
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            w = np.where(self.ids[at] == ids, w * self.idf[at], w)
        return w


def idf(df: np.ndarray, docs: int) -> np.ndarray:
    return 0.8 + 0.2 * np.minimum(1, np.log(docs / df) / np.log(RARE))


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, 48-bit shingle id, tf) of all rows, sorted by row then id.

    A text of one to ``words - 1`` words has one shingle, the whole of it; one without
    words has none."""
    h, row = word_hashes(data, offsets)
    n = len(offsets) - 1
    lengths = np.bincount(row, minlength=n)
    total = np.zeros(len(h), np.uint64)
    starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
    place = np.arange(len(h)) - starts[row]
    left = lengths[row] - place
    for k in range(words):
        follow = np.zeros(len(h), np.uint64)
        follow[: len(h) - k] = h[k:]
        total = mix(total * np.uint64(0x100000001B3) + np.where(left > k, follow, np.uint64(0)) + np.uint64(k + 1))
    begins = (left >= words) | ((place == 0) & (lengths[row] < words))
    key = (row[begins].astype(np.uint64) << np.uint64(48)) | (total[begins] >> np.uint64(16))
    key, tf = np.unique(key, return_counts=True)
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), tf


def _row_groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most 60,000 rows (the row number shares a word with the shingle)."""
    for batch in slices(batches, column, SLICE_BYTES):
        for i in range(0, batch.num_rows, 60_000):
            yield batch.slice(i, 60_000)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents and bytes of text."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_or_empty("text"))).alias("b")).first()
    return r["n"], r["b"] or 0


def frequent_shingles(docs: DataFrame, words: int = 5) -> Frequent:
    """The shingles in at least one of ``RARE`` documents with their idf, from the exact
    document counts of all shingles.

    Tasks send their distinct shingles, sorted and packed (four bytes each and a small
    table), to groups by ranges of the ids, which are even for any text; a shingle of
    very many documents comes once from each task."""
    n_docs, n_bytes = corpus_size(docs)
    bits = max(3, min(16, int(np.ceil(np.log2(max(1, n_bytes / SHARD_BYTES))))))
    least = max(2, -(-n_docs // RARE))
    tables = 1 << (16 - bits)

    def send(ids: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        top = (ids >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(top, np.arange((1 << bits) + 1) * tables)
        blobs, counts = [], []
        for a, b in zip(cuts, cuts[1:]):
            many = np.flatnonzero(df[a:b] > 1)
            counts.append(np.bincount(top[a:b] & (tables - 1), minlength=tables).astype("<u4").tobytes()
                          + np.c_[many, df[a:b][many]].astype("<u4").tobytes())
            blobs.append((ids[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(np.arange(1 << bits, dtype=np.int32)), pa.array(blobs), pa.array(counts)], names=["shard", "low", "counts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            return send(*np.unique(np.concatenate(held), return_counts=True))

        for batch in _row_groups(batches, 0):
            _, ids, _ = shingles(*string_buffer(batch.column(0)), words)
            held.append(ids)
            size += len(ids)
            if size >= GATHER:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        ids, weights = [], []
        shard = np.uint64(table.column("shard")[0].as_py() if table.num_rows else 0)
        for low, packed in zip(table.column("low"), table.column("counts")):
            low, packed = np.frombuffer(low.as_buffer(), "<u4"), np.frombuffer(packed.as_buffer(), "<u4")
            top = np.repeat(np.arange(tables, dtype=np.uint64), packed[:tables]) + shard * np.uint64(tables)
            df = np.ones(len(low), np.uint32)
            many = packed[tables:].reshape(-1, 2)
            df[many[:, 0]] = many[:, 1]
            ids.append((top << np.uint64(32)) | low)
            weights.append(df)
        ids, weights = np.concatenate(ids), np.concatenate(weights)
        order = np.argsort(ids, kind="stable")
        ids, weights = ids[order], weights[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, np.int64)
        df = np.add.reduceat(weights, first, dtype=np.int64) if len(ids) else np.empty(0, np.int64)
        keep = df >= least
        return pa.table({"id": ids[first][keep].astype(np.int64), "df": df[keep]})

    packed = docs.select(text_or_empty("text").alias("_lm_text")).mapInArrow(gather, "shard int, low binary, counts binary")
    rows = packed.groupBy("shard").applyInArrow(count, "id long, df long").toArrow()  # at most RARE * mean shingles of a document
    ids, df = rows.column("id").to_numpy().astype(np.uint64), rows.column("df").to_numpy()
    order = np.argsort(ids)
    return Frequent(ids[order], idf(df[order], max(1, n_docs)))


_FIELD = np.uint64((1 << 23) - 1)


def _uniform(field: np.ndarray) -> np.ndarray:
    """Numbers inside (0, 1) from 23 bits each: exact in single precision, never 0 or 1."""
    out = field.view(np.int64).astype(np.float32)
    out += np.float32(0.5)
    out *= np.float32(2.0**-23)
    return out


def _log_product(x: np.ndarray) -> np.ndarray:
    """The logarithm of the product of two uniform numbers (minus a gamma(2, 1) variable) from the top 46 bits."""
    u = _uniform(x >> np.uint64(41))
    u *= _uniform((x >> np.uint64(18)) & _FIELD)
    return np.log(u, out=u)


def signatures(row: np.ndarray, ids: np.ndarray, weights: np.ndarray, n: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Rows with shingles, and their band keys ``[row, band]``, by improved consistent weighted sampling.

    Works on runs of rows with about ``SIGN_BLOCK`` shingles, so that the arrays of a step stay in the cache."""
    have = np.flatnonzero(np.bincount(row, minlength=n))
    if not len(have):
        return have, np.empty((0, bands.bands), np.int64)
    starts = np.r_[np.searchsorted(row, have), len(row)]
    log_w = np.log(weights).astype(np.float32)
    rng = np.random.default_rng(bands.seed)
    draws = [(rng.integers(1, 2**63, 3, dtype=np.uint64) << np.uint64(1)) | np.uint64(1) for _ in range(bands.bands * bands.rows)]
    keys = np.zeros((len(have), bands.bands), np.uint64)
    first = 0
    while first < len(have):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + SIGN_BLOCK, "right")) - 1)
        a, b = starts[first], starts[last]
        for k, sample in enumerate(_samples(ids[a:b], log_w[a:b], starts[first:last] - a, draws)):
            band = k // bands.rows
            keys[first:last, band] = mix(keys[first:last, band] * np.uint64(0x100000001B3) + sample)
        first = last
    return have, keys.view(np.int64)


def _samples(ids: np.ndarray, log_w: np.ndarray, starts: np.ndarray, draws: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each draw the sample (a hash of shingle and level) of every set; sets begin at ``starts``."""
    lens = np.diff(np.r_[starts, len(ids)])
    uneven = np.flatnonzero(log_w)  # a weight of 1 has t = 0 on every draw
    t = np.zeros(len(ids), np.float32)
    for a, b, c in draws:
        x = mix(ids * a + b)
        y = x >> np.uint64(31)
        y ^= x
        y *= c
        r = _log_product(x)  # minus the scale
        gamma = _log_product(y)
        beta = (x & np.uint64((1 << 18) - 1)).view(np.int64).astype(np.float32)
        beta *= np.float32(2.0**-18)
        t[uneven] = np.floor(beta[uneven] - log_w[uneven] / r[uneven])
        beta -= t
        beta -= np.float32(1)
        beta *= r
        value = np.log(np.negative(gamma, out=gamma), out=gamma)
        value -= beta
        lowest = np.minimum.reduceat(value, starts)
        hit = np.flatnonzero(value == np.repeat(lowest, lens))
        at = hit[np.searchsorted(hit, starts)]
        yield mix(ids[at] * c + t[at].astype(np.int64).astype(np.uint64))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted ids, weights); 0 where either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][at] == b[0]
    wa, wb = a[1][at[both]], b[1][both]
    shared = np.minimum(wa, wb).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def verify(pairs: DataFrame, texts: DataFrame, model, bands: Bands, block: int = 256) -> DataFrame:
    """The pairs (``a``, ``b``) whose weighted Jaccard similarity reaches the threshold.

    The pairs of one ``a`` are dealt into blocks of about ``block``; each block gets the text
    of ``a`` once and those of its ``b``. Only texts of documents in a pair are shuffled."""
    total = pairs.count()
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    parts = F.ceil(F.col("m") / F.lit(block)).cast("int")
    dealt = stage(
        spread_join(pairs, degree, "a", "m", total, F.xxhash64("b")).withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int")).select("a", "b", "part"),
        "pairs",
    )
    wanted = dealt.select("a", "part", F.col("b").alias("doc")).unionAll(dealt.select("a", "part", F.col("a").alias("doc")).distinct())
    held = _only(texts, wanted.select("doc"))
    rows = wanted.join(held, "doc")

    def compare(table: pa.Table) -> pa.Table:
        a = table.column("a")[0].as_py()
        doc = table.column("doc").to_numpy()
        sets = _sets(doc, pa.concat_arrays(table.column("text").chunks), model.value, bands.words)
        hits = [b for b in sets if b != a and weighted_jaccard(sets[a], sets[b]) >= bands.threshold] if a in sets else []
        return pa.table({"a": pa.array([a] * len(hits), pa.int64()), "b": pa.array(hits, pa.int64())})

    return stage(rows.groupBy("a", "part").applyInArrow(compare, "a long, b long"), "links")


def _only(texts: DataFrame, docs: DataFrame, bits: int = 22) -> DataFrame:
    """``texts`` without most rows that ``docs`` doesn't name: a bitmap of a fixed size goes to the scan, so only
    named texts (and a few others, which the join drops) are shuffled."""
    spark = texts.sparkSession
    words = docs.select((F.xxhash64("doc").bitwiseAND(F.lit((1 << bits) - 1))).alias("s")).select(
        F.shiftright("s", 6).alias("w"), F.col("s").bitwiseAND(F.lit(63)).cast("int").alias("k"))
    rows = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("m")).toArrow()  # at most 2**(bits - 6) rows
    marks = np.zeros(1 << (bits - 6), np.int64)
    marks[rows.column("w").to_numpy()] = rows.column("m").to_numpy()
    shared = spark.sparkContext.broadcast(np.unpackbits(marks.view(np.uint8), bitorder="little"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value[batch.column(1).to_numpy(zero_copy_only=False)] > 0)).select(["doc", "text"])

    src = texts.select("doc", F.xxhash64("doc").bitwiseAND(F.lit((1 << bits) - 1)).alias("slot"), "text")
    return src.mapInArrow(keep, "doc long, text string")


def _sets(doc: np.ndarray, column: pa.Array, model: Frequent, words: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(sorted shingle ids, weights) of each text by its document."""
    sets = {}
    for i in range(0, len(column), 1000):
        row, ids, tf = shingles(*string_buffer(column.slice(i, 1000)), words)
        w = model.weights(ids, tf)
        cuts = np.searchsorted(row, np.arange(min(1000, len(column) - i) + 1))
        sets |= {int(doc[i + k]): (ids[x:y], w[x:y]) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))}
    return sets


def _close_pairs(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> np.ndarray:
    """(i, j) of all sets of ``left`` and ``right`` whose similarity may reach ``threshold``.

    The product of the roots of two weights is at least the smaller one, so one matrix product
    over the shingles in several sets bounds every overlap from above."""
    ids, column, counts = np.unique(np.concatenate([s[0] for s in left + right]), return_inverse=True, return_counts=True)
    place = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[column]
    lens = np.array([len(s[0]) for s in left + right])
    row = np.repeat(np.arange(len(lens)), lens)
    weights = np.concatenate([s[1] for s in left + right])
    x = np.zeros((len(lens), max(1, int((counts > 1).sum()))), np.float32)
    x[row[place >= 0], place[place >= 0]] = np.sqrt(weights[place >= 0])
    total = np.bincount(row, weights, minlength=len(lens))
    n = len(left)
    need = (total[:n, None] + total[None, n:]) * (threshold / (1 + threshold))
    return np.argwhere(x[:n] @ x[n:].T >= need * (1 - 1e-4))


def compare_buckets(open_: DataFrame, texts: DataFrame, model, bands: Bands, block: int = 256, per_task: int = 2000) -> DataFrame:
    """Links (``a``, ``b``) that join different components of a bucket: with the components so far they
    connect whatever all similar pairs of the buckets connect.

    ``open_``: ``bucket``, ``rep``, ``component``. Large buckets are dealt into parts of about
    ``block`` members and a task compares two parts; small buckets share tasks. A task gets
    each text once and sends at most one link a member."""
    sizes = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts"))
    total = open_.count()
    tasks = max(1, total // per_task)
    dealt = spread_join(open_, sizes, "bucket", "m", total, F.xxhash64("rep")).select(
        "bucket", F.col("rep").alias("doc"), "component",
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("bucket"), F.lit(tasks))).otherwise(F.col("bucket")).alias("slot"),
        F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("bucket", "doc", "component", "slot", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    rows = dealt.join(_only(texts, open_.select(F.col("rep").alias("doc"))), "doc")

    def compare(table: pa.Table) -> pa.Table:
        doc, bucket, part, component = (table.column(c).to_numpy() for c in ("doc", "bucket", "part", "component"))
        unique, at = np.unique(doc, return_index=True)
        sets = _sets(unique, pa.concat_arrays(table.column("text").chunks).take(pa.array(at)), model.value, bands.words)
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        links = []
        order = np.lexsort((doc, part, bucket))
        cuts = np.r_[np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]), len(order)]
        for i, j in zip(cuts, cuts[1:]):
            mine = order[i:j]
            left, right = mine[part[mine] == lo], mine[part[mine] == hi]
            if len(left) * len(right) > 400:
                pairs = _close_pairs([sets[int(d)] for d in doc[left]], [sets[int(d)] for d in doc[right]], bands.threshold).tolist()
            else:
                pairs = [(x, y) for x in range(len(left)) for y in range(len(right))]
            for x, y in pairs:
                if lo == hi and x >= y:
                    continue
                a, b = left[x], right[y]
                ca, cb = find(int(component[a])), find(int(component[b]))
                if ca != cb and weighted_jaccard(sets[int(doc[a])], sets[int(doc[b])]) >= bands.threshold:
                    parent[max(ca, cb)] = min(ca, cb)
                    links.append((int(doc[a]), int(doc[b])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return stage(rows.groupBy("slot", "lo", "hi").applyInArrow(compare, "a long, b long"), "links")


def _open_buckets(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members (``bucket``, ``rep``, ``component``) of buckets with several components."""
    label = connected_components(links).select(F.col("node").alias("rep"), "component")
    named = stage(members.join(label, "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component")), "named")
    several = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    return stage(named.join(several, "bucket"), "open")


def near_duplicates(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): doc_id, class_id and kept.

    Equal texts (NULL counts as empty) and texts with a weighted Jaccard similarity of
    ``bands.threshold`` or more are linked; a class is a component of links, its id the
    smallest doc_id, and one document of each class is kept. Rows with a NULL doc_id have
    no class and are kept. Rows that repeat an id with one text count as copies; if their
    texts differ they join their classes.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    ided = src.where("doc_id IS NOT NULL")
    model = spark.sparkContext.broadcast(frequent_shingles(src, bands.words))
    names = [f"k{i}" for i in range(bands.bands)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _row_groups(batches, 2):
            row, ids, tf = shingles(*string_buffer(batch.column(2)), bands.words)
            have, keys = signatures(row, ids, model.value.weights(ids, tf), batch.num_rows, bands)
            mask = np.ones(batch.num_rows, bool)
            mask[have] = False
            full = np.zeros((batch.num_rows, bands.bands), np.int64)
            full[have] = keys
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(full[:, i], mask=mask) for i in range(bands.bands))], names=["doc_id", "text_key", *names])

    keyed = ided.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), "text")
    signed = stage(keyed.mapInArrow(sign, "doc_id long, text_key binary, " + ", ".join(f"{c} long" for c in names)), "signatures")
    # equal texts: one class, all further work on its smallest id
    classes = stage(signed.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in names)), "classes")
    buckets = classes.select("rep", F.posexplode(F.array(*names)).alias("band", "key")).where("key IS NOT NULL").select(F.xxhash64("band", "key").alias("bucket"), "rep")
    firsts = buckets.groupBy("bucket").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = stage(buckets.join(firsts, "bucket").select("bucket", "rep", "a"), "buckets")
    texts = ided.select(F.col("doc_id").alias("doc"), "text")
    star = stage(members.where("a < rep").select("a", F.col("rep").alias("b")).distinct(), "star")
    links = verify(star, texts, model, bands)
    open_ = _open_buckets(members, links)
    more = compare_buckets(open_, texts, model, bands)
    label = connected_components(links.unionAll(more)).select(F.col("node").alias("rep"), "component")
    info = stage(classes.select("text_key", "rep", "n").join(label, "rep", "left").select("text_key", "n", F.coalesce("component", "rep").alias("class_id")), "info")
    total = signed.count()
    out = spread_join(signed.select("doc_id", "text_key"), info, "text_key", "n", total, F.xxhash64("doc_id", F.monotonically_increasing_id()))
    out = out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    alone = src.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionAll(alone)
