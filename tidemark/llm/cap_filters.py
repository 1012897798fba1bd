"""Near-duplicate vectors by spherical-cap filters.

Directions come from a structured random product code: the (randomly rotated)
space is cut into blocks, each block has its own random unit codewords, and a
filter is one codeword per block, so a few hundred codewords stand for very many
filters. A vector's score on a filter is the sum of its scores in the blocks, and
list decoding (block by block, dropping partial sums that the best rest can't
lift over the cap) finds all filters whose cap the vector lies in. Two vectors
that share a filter are candidates; every candidate is verified by the cosine in
double precision. Several independent codes raise the recall.

Equal directions are joined first (rows of one label and one vector are a class),
so copies never form pairs; filter buckets are compared in blocks of bounded size.
A pair counts in the first filter that both vectors share (every vector carries its
filters), so tasks add up link numbers and send one row a vector, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import spread_join, stage

THRESHOLD = 0.98


class CapCode(NamedTuple):
    """``codes`` independent product codes of ``blocks`` blocks with ``words`` codewords each
    (0: as many as give about ``per_filter`` classes a filter, from the counted classes).
    The cap is set so that a vector lies in about ``lists`` filters of each code."""

    codes: int = 8
    blocks: int = 2
    words: int = 0
    per_filter: int = 12
    lists: float = 3.0
    seed: int = 5

    def sized(self, classes: int) -> CapCode:
        return self if self.words else self._replace(words=max(16, math.ceil((classes / self.per_filter) ** (1 / self.blocks))))

    def cap(self, dim: int) -> float:
        """A random filter's score of a unit vector is about normal with variance 1/dim."""
        share = min(0.5, self.lists / self.words**self.blocks)
        return NormalDist().inv_cdf(1 - share) / math.sqrt(dim)


def codebook(dim: int, code: CapCode, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rotation and the codewords [block, word, block width] of code ``k``."""
    rng = np.random.default_rng([code.seed, k, dim])
    width = -(-dim // code.blocks)
    turn, _ = np.linalg.qr(rng.standard_normal((width * code.blocks, width * code.blocks)))
    words = rng.standard_normal((code.blocks, code.words, width))
    return turn[:dim], words / np.linalg.norm(words, axis=2, keepdims=True) / np.sqrt(code.blocks)


def decode(unit: np.ndarray, code: CapCode, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All (row, filter) with a score of at least ``cap``: list decoding block by block.

    Rows in no filter go to their best one, so that equal rows always meet."""
    turn, words = codebook(unit.shape[1], code, k)
    cap = code.cap(unit.shape[1])
    turned = (unit @ turn).reshape(len(unit), code.blocks, -1)
    scores = np.einsum("nbw,bcw->nbc", turned, words)
    best_rest = np.concatenate([np.cumsum(scores.max(2)[:, ::-1], 1)[:, ::-1][:, 1:], np.zeros((len(unit), 1))], 1)
    rows, sums, ids = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), np.int64)
    for b in range(code.blocks):
        total = sums[:, None] + scores[rows, b]
        keep, word = np.nonzero(total + best_rest[rows, b][:, None] >= cap)
        rows, sums, ids = rows[keep], total[keep, word], ids[keep] * code.words + word
    missing = np.setdiff1d(np.arange(len(unit)), rows)
    top = np.zeros(len(missing), np.int64)
    for b in range(code.blocks):
        top = top * code.words + scores[missing, b].argmax(1)
    return np.concatenate([rows, missing]), np.concatenate([ids, top])


def _first_shared(a: np.ndarray, b: np.ndarray, filters: np.ndarray, place: int) -> np.ndarray:
    """Whether the rows ``a[i]`` and ``b[i]`` share no filter below ``place`` (rows of ``filters`` are padded with -1)."""
    alone = np.ones(len(a), bool)
    early = np.where(filters < place, filters, -1)
    step = max(1, (1 << 20) // filters.shape[1])
    for k in range(0, len(a), step):
        left = np.arange(k, min(k + step, len(a)))
        for j in range(filters.shape[1]):
            mine = early[a[left], j]
            met = ((filters[b[left]] == mine[:, None]) & (mine >= 0)[:, None]).any(1)
            alone[left[met]] = False
            left = left[~met]
            if not len(left):
                break
    return alone


def _lowest_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest one that links (``a[i]``, ``b[i]``) reach."""
    low = np.arange(n)
    while len(a):
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        open_ = low[a] != low[b]
        if not open_.any():
            # every link now lies within one label; a label is its own label
            while (low[low] != low).any():
                low = low[low]
            break
    return low


def valid_vector(name: str) -> Column:
    """Whether a vector has a direction: not NULL or empty, all components finite, not all zero."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.col(name).isNotNull() & F.forall(name, ok) & F.exists(name, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    m = m / np.abs(m).max(1, keepdims=True)  # squares of very large or small components stay finite
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _padded(lists: pa.Array) -> np.ndarray:
    """Lists of numbers as the rows of a matrix, padded with -1."""
    lens = lists.value_lengths().to_numpy()
    out = np.full((len(lens), max(1, lens.max())), -1, np.int64)
    out[np.arange(out.shape[1]) < lens[:, None]] = lists.flatten().to_numpy()
    return out


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, code: CapCode = CapCode(), block: int = 1024, per_task: int = 4000) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id``, ``embedding``, ``label``): vec_id, n_links
    (other rows linked directly), component_id and kept.

    Rows link when their labels are equal and not NULL and the cosine is at least
    ``threshold``; vectors that are NULL, empty, zero or hold NULL or non-finite
    components link with nothing. Vectors of different lengths never link. Repeated
    ``vec_id`` values are rows of their own that share a component id.
    """
    src = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("l"))
    usable = valid_vector("v") & F.col("l").isNotNull() & F.col("vec_id").isNotNull()
    keyed = src.select("vec_id", "v", "l", usable.alias("ok")).withColumn(
        "key", F.when(F.col("ok"), F.sha2(F.concat_ws("|", F.col("l").cast("string"), F.col("v").cast("string")).cast("binary"), 256)))
    rows = stage(keyed.select("vec_id", "key"), "vectors")
    classes = stage(keyed.where("ok").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"), F.first("l").alias("l")), "classes")

    sized = code.sized(classes.count())

    def caps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                part = batch.take(pa.array(at))
                unit = _matrix(part.column("v"))
                rows_of, places = [], []
                for k in range(sized.codes):
                    row, found = decode(unit, sized, k)
                    rows_of.append(row)
                    places.append(found + k * sized.words**sized.blocks)
                row, place = np.concatenate(rows_of), np.concatenate(places)
                order = np.lexsort((place, row))
                row, place = row[order], place[order]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(unit) + 1)).astype(np.int32)), pa.array(place))
                for i in range(0, len(row), 10_000):
                    who = pa.array(row[i : i + 10_000])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("l").take(who), part.column("dim").take(who), pa.array(place[i : i + 10_000]), lists.take(who),
                         part.column("rep").take(who), part.column("n").take(who), part.column("v").take(who)],
                        names=["l", "dim", "place", "filters", "rep", "n", "v"])

    kind = classes.schema["l"].dataType.simpleString()
    ids = classes.schema["rep"].dataType.simpleString()
    members = stage(classes.select("rep", "n", "v", "l", F.size("v").alias("dim")).mapInArrow(
        caps, f"l {kind}, dim int, place long, filters array<long>, rep {ids}, n long, v array<double>"), "caps")
    # a bucket of m members is dealt into s = ceil(m / block) parts; tasks compare part i with part j >= i
    # (small buckets share tasks)
    bucketed = members.withColumn("bucket", F.xxhash64("l", "dim", "place"))
    sizes = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("parts", F.ceil(F.col("m") / F.lit(block)).cast("int"))
    total = members.count()
    tasks = max(1, total // per_task)
    dealt = spread_join(bucketed, sizes, "bucket", "m", total, F.xxhash64("rep")).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(
        "bucket", "l", "dim", "place", "filters", "rep", "n", "v", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
        F.when(F.col("parts") == 1, F.pmod("bucket", F.lit(tasks))).otherwise(F.col("bucket")).alias("slot"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("bucket", "l", "dim", "place", "rep")])
        rep, n, part, key, dim, place = (table.column(c).to_numpy() for c in ("rep", "n", "part", "bucket", "dim", "place"))
        label = table.column("l").to_numpy()
        vectors, filters = (pa.concat_arrays(table.column(c).chunks) for c in ("v", "filters"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        new = (key[1:] != key[:-1]) | (label[1:] != label[:-1]) | (dim[1:] != dim[:-1]) | (place[1:] != place[:-1])  # also parts buckets of one hash
        cuts = np.r_[0, np.flatnonzero(new) + 1, len(rep)]
        doc, node = np.unique(rep, return_inverse=True)
        links = np.zeros(len(doc), np.int64)
        found = []
        for i, j in zip(cuts, cuts[1:]):
            left, right = np.flatnonzero(part[i:j] == lo), np.flatnonzero(part[i:j] == hi)
            if not len(left) or not len(right):
                continue
            unit = _matrix(vectors.slice(i, j - i))
            a, b = np.nonzero(unit[left] @ unit[right].T >= threshold - 1e-9)
            a, b = left[a], right[b]
            if lo == hi:
                a, b = a[a < b], b[a < b]
            if not len(a):
                continue
            # the same sum for every bucket that holds the pair
            fits = np.concatenate([(unit[a[k : k + block]] * unit[b[k : k + block]]).sum(1) >= threshold for k in range(0, len(a), block)])
            a, b = a[fits], b[fits]
            first = _first_shared(a, b, _padded(filters.slice(i, j - i)), place[i])
            a, b = a[first] + i, b[first] + i
            np.add.at(links, node[a], n[b])
            np.add.at(links, node[b], n[a])
            found.append(np.stack([node[a], node[b]]))
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        low = _lowest_reached(a, b, len(doc))
        have = np.flatnonzero(links)
        return pa.table({"rep": doc[have], "d": links[have], "low": doc[low[have]]})

    met = stage(dealt.groupBy("slot", "lo", "hi").applyInArrow(compare, f"rep {ids}, d long, low {ids}"), "links")
    degree = met.groupBy("rep").agg(F.sum("d").alias("d"))
    labels = connected_components(met.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    info = (
        classes.select("key", "rep", "n").join(degree, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
        .select("key", "n", (F.col("n") - 1 + F.coalesce("d", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    info = stage(info, "info")
    total = rows.count()
    linked = spread_join(rows.where("key IS NOT NULL"), info, "key", "n", total, F.xxhash64("vec_id")).select("vec_id", "links", "component")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    return linked.unionAll(alone).select(
        "vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
