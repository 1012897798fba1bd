"""URL filter: path rules first, a character language-model ratio for the rest.

Two smoothed variable-order Markov models over bytes (order 0 to ``order``, each
order smoothed by the next shorter one) are counted over the URLs that the rules
allow and over those that they block. A URL without a rule is judged by the
difference of the two log-likelihoods divided by its length, against a threshold
that is calibrated on URLs kept out of the counts.

Counts are exact: n-grams are counted by 64-bit keys of context and symbol (no slots, so none collide
but by a chance of a few in a million), by a partial aggregate over all rows. The model is a table of all
n-grams, whatever their number: nothing is pruned or sent to the driver, and only Spark's own joins broadcast
what is small. Its probabilities are joined order by order (an n-gram has at most 258 longer ones, a context at
most 257 symbols, so no key is hot), and each block of URLs looks up the different n-grams that it holds. So a
score depends on the counts alone, not on the size of the table.

Cases: NULL urls are empty texts; a text of any length is read whole, in batches bounded by bytes; repeated
rows count as often as they occur; an empty table gives an empty table; result columns are fixed, whatever
others the input has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.llm.shared import slices, stage, string_buffer, text_or_empty
from tidemark.llm.words import mix

SLICE_BYTES = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    allow: bool
    host: str
    path: str

    @property
    def label(self) -> str:
        return self.host + self.path


class ModelSize(NamedTuple):
    """``order``: longest context; ``max_entries``: bound of a copy for one process (``fit_model``), of no
    effect on ``judge_urls``; ``prior``: weight of the shorter context; ``folds``: one of so many URLs calibrates."""

    order: int = 4
    max_entries: int = 4_000_000
    prior: float = 2.0
    folds: int = 5


class Model(NamedTuple):
    """Sorted keys of contexts and of n-grams (context and symbol) with their counts in both classes (blocked, allowed)."""

    contexts: np.ndarray
    context_counts: np.ndarray
    grams: np.ndarray
    gram_counts: np.ndarray


def url_parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL or without ``://``."""
    u = text_or_empty(url)
    rest = F.when(F.locate("://", u) > 0, F.expr(f"substring(coalesce(cast(`{url}` as string), ''), locate('://', coalesce(cast(`{url}` as string), '')) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def model_text(url: str) -> Column:
    """What the models read: the whole url, scheme and host A-Z lower-cased; without ``://`` the raw string."""
    u = text_or_empty(url)
    at = F.locate("://", u)
    begin = F.when(at > 0, F.length(F.regexp_extract(F.substring(u, at + 3, F.length(u)), r"^([^/?#]*)", 1)) + at + 2).otherwise(0)
    return F.concat(F.translate(F.substring(u, F.lit(1), begin), _UPPER, _LOWER), F.substring(u, begin + 1, F.length(u)))


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and whether it allows (NULL where none fits)."""
    label, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: len(r.label)):  # a later, longer rule wins
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        label = F.when(fits, rule.label).otherwise(label)
        allow = F.when(fits, rule.allow).otherwise(allow)
    return label, allow


def _keys(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte and end mark: the keys of its n-gram and of its context at each order, and its row."""
    n = len(offsets) - 1
    symbols = np.zeros(len(data) + n, np.uint64)
    ends = offsets[1:] + np.arange(n)
    inner = np.ones(len(symbols), bool)
    inner[ends] = False
    symbols[inner] = data.astype(np.uint64) + np.uint64(1)
    begins = offsets[:-1] + np.arange(n)
    row = np.repeat(np.arange(n), np.diff(offsets) + 1)
    at = np.arange(len(symbols)) - begins[row]
    context = np.zeros(len(symbols), np.uint64)
    gram = np.empty((order + 1, len(symbols)), np.int64)
    ctx = np.empty_like(gram)
    for k in range(order + 1):
        ctx[k] = context.view(np.int64)
        gram[k] = mix(context * np.uint64(1009) + symbols + np.uint64(7)).view(np.int64)
        before = np.zeros_like(symbols)
        before[k + 1 :] = symbols[: -(k + 1)] if k + 1 <= len(symbols) else 0
        before[at <= k] = 300  # before the start
        context = mix(context * np.uint64(257) + before + np.uint64(k + 1))
    return gram, ctx, row


def count_grams(urls: DataFrame, order: int) -> DataFrame:
    """(order, context, gram, lower, blocked, allowed): how often each n-gram occurs in the rows of ``urls``
    (``text``, ``allow``); ``lower`` is the n-gram with one symbol less before it. Rows without ``allow``
    give their n-grams, but count for neither class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, SLICE_BYTES):
            allow = np.array([-1 if a is None else int(a) for a in batch.column(1).to_pylist()])
            gram, ctx, row = _keys(*string_buffer(batch.column(0)), order)
            lower = np.concatenate([np.zeros_like(gram[:1]), gram[:-1]])
            keys, first, back = np.unique(gram.ravel(), return_index=True, return_inverse=True)
            allowed = np.tile(allow[row], order + 1)
            counts = [np.bincount(back, allowed == c, minlength=len(keys)).astype(np.int64) for c in (0, 1)]
            columns = (first // gram.shape[1], ctx.ravel()[first], keys, lower.ravel()[first], *counts)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["order", "context", "gram", "lower", "blocked", "allowed"])

    rows = urls.mapInArrow(run, "order long, context long, gram long, lower long, blocked long, allowed long")
    return rows.groupBy("order", "context", "gram", "lower").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))


def gram_probabilities(grams: DataFrame, size: ModelSize) -> DataFrame:
    """(gram, p_blocked, p_allowed): the smoothed probability of every longest n-gram of ``grams`` (of ``count_grams``)
    in both classes. Each order is joined with the next shorter one."""
    context = Window.partitionBy("context")
    for k in range(size.order + 1):
        level = grams.where(F.col("order") == k).select(
            "gram", "lower", "blocked", "allowed",
            F.sum("blocked").over(context).alias("seen_blocked"), F.sum("allowed").over(context).alias("seen_allowed"),
        )
        if k == 0:
            level = level.withColumns({"p_blocked": F.lit(1 / 257), "p_allowed": F.lit(1 / 257)})
        else:
            level = level.join(shorter.withColumnRenamed("gram", "lower"), "lower")
        shorter = level.select("gram", *[
            ((F.col(c) + F.lit(size.prior) * F.col(f"p_{c}")) / (F.col(f"seen_{c}") + F.lit(size.prior))).alias(f"p_{c}")
            for c in ("blocked", "allowed")
        ])
    return shorter


def fit_model(urls: DataFrame, size: ModelSize) -> Model:
    """A copy of the model of all rows of ``urls`` for one process, to probe single texts. It loses its rarest contexts
    whole where it would exceed ``max_entries`` (there the shorter context speaks alone), so ``judge_urls`` does not use it."""
    grams = stage(count_grams(urls, size.order).select("context", "gram", "blocked", "allowed"), "url-grams")
    contexts = grams.groupBy("context").agg(F.sum(F.col("blocked") + F.col("allowed")).alias("n"), F.count(F.lit(1)).alias("entries"))
    # contexts by the size of their count, in steps of a sixteenth of a doubling: at most some hundred rows
    step = F.floor(F.log2("n") * 16)
    sizes = sorted(((r["step"], r["entries"]) for r in contexts.groupBy(step.alias("step")).agg(F.sum(F.col("entries") + 1).alias("entries")).collect()), reverse=True)
    total, least = 0, None
    for at, entries in sizes:
        total += entries
        if total > size.max_entries and least is not None:
            grams = grams.join(contexts.where(step >= least).select("context"), "context")
            break
        least = at
    rows = grams.toArrow()
    context, gram, blocked, allowed = (rows.column(c).to_numpy() for c in ("context", "gram", "blocked", "allowed"))
    counts = np.stack([blocked, allowed], 1).astype(np.int64).reshape(-1, 2)
    known, back = np.unique(context, return_inverse=True)
    sums = np.zeros((len(known), 2), np.int64)
    np.add.at(sums, back, counts)
    order = np.argsort(gram)
    return Model(known, sums, gram[order], counts[order])


def _counts(keys: np.ndarray, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of ``keys`` (zero where the table has none)."""
    if not len(table):
        return np.zeros((len(keys), 2))
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where((table[at] == keys)[:, None], counts[at], 0)


def symbol_probabilities(data: np.ndarray, offsets: np.ndarray, model: Model, size: ModelSize) -> tuple[np.ndarray, np.ndarray]:
    """Per byte and end mark: its probability under (blocked, allowed), and its row."""
    gram, ctx, row = _keys(data, offsets, size.order)
    p = np.full((gram.shape[1], 2), 1 / 257)
    for k in range(size.order + 1):
        keys, back = np.unique(ctx[k], return_inverse=True)
        seen = _counts(keys, model.contexts, model.context_counts)[back]
        keys, back = np.unique(gram[k], return_inverse=True)
        # an n-gram counts only below a context that was kept
        here = _counts(keys, model.grams, model.gram_counts)[back] * (seen.sum(1, keepdims=True) > 0)
        p = (here + size.prior * p) / (seen + size.prior)
    return p, row


def url_scores(data: np.ndarray, offsets: np.ndarray, model: Model, size: ModelSize) -> np.ndarray:
    """Per URL: (log p under allowed - log p under blocked) per symbol."""
    p, row = symbol_probabilities(data, offsets, model, size)
    return _mean_ratios(np.log(p), row, offsets)


def _mean_ratios(logs: np.ndarray, row: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row: the mean of (allowed - blocked) over its bytes and its end mark."""
    return np.bincount(row, logs[:, 1] - logs[:, 0], minlength=len(offsets) - 1) / (np.diff(offsets) + 1)


def text_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of their block: runs of rows with about ``SLICE_BYTES`` of text (the last column) each.
    Written once, so that every reader sees the same blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(slices(batches, -1, SLICE_BYTES)):
            yield batch.append_column("block", pa.array(np.full(batch.num_rows, first + i)))

    return stage(rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("block", LongType())])), "url-blocks")


def score_blocks(blocks: DataFrame, probabilities: DataFrame, order: int) -> DataFrame:
    """``blocks`` (of ``text_blocks``) with each text's score in place of the text and the block: every block asks for
    the different longest n-grams that it holds and meets their probabilities again."""
    text = blocks.columns[-2]
    kept = blocks.columns[:-2]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, SLICE_BYTES):
            gram, _, row = _keys(*string_buffer(batch.column(0)), order)
            block = batch.column(1).to_numpy()
            for b in np.unique(block):
                keys = np.unique(gram[-1][block[row] == b])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), b)), pa.array(keys)], names=["block", "gram"])

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        data, offsets = string_buffer(rows.column(text))
        gram, _, row = _keys(data, offsets, order)
        keys, first = np.unique(found.column("gram").to_numpy(), return_index=True)
        logs = np.log(np.stack([found.column(c).to_numpy()[first] for c in ("p_blocked", "p_allowed")], 1))[np.searchsorted(keys, gram[-1])]
        return rows.select(kept).append_column("score", pa.array(_mean_ratios(logs, row, offsets)))

    asked = blocks.select(text, "block").mapInArrow(ask, "block long, gram long")
    found = asked.join(probabilities, "gram")
    schema = StructType([*blocks.schema.fields[:-2], StructField("score", DoubleType())])
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, schema)


def calibrate(hist: list[tuple[float, bool, int]]) -> float:
    """The threshold with the best balanced accuracy over a histogram (score bin, allow, n);
    the middle of the best stretch. Without both classes everything passes or 0 decides."""
    total = {c: sum(n for _, a, n in hist if a is c) for c in (True, False)}
    if not total[False]:
        return float("-inf")
    if not total[True]:
        return float("inf")
    below = {True: 0, False: 0}
    best, cuts, found = -1.0, sorted({b for b, _, _ in hist}), []
    by_bin: dict[float, list[tuple[bool, int]]] = {}
    for b, a, n in hist:
        by_bin.setdefault(b, []).append((a, n))
    for i, b in enumerate(cuts):
        quality = below[False] / total[False] + 1 - below[True] / total[True]
        cut = b if i == 0 else (cuts[i - 1] + b) / 2
        if quality > best + 1e-12:
            best, found = quality, [cut]
        elif quality > best - 1e-12:
            found.append(cut)
        for a, n in by_bin[b]:
            below[a] += n
    return found[len(found) // 2]


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", size: ModelSize = ModelSize()
) -> DataFrame:
    """One row per page: id, host, path, the rule that decides (else NULL), the
    model's score, and ``allow`` (the rule's, else score >= threshold).

    Rows whose rule is known train and calibrate; with no blocked URL everything
    passes, with no allowed one nothing does. Rules look at host and path, the model
    at the whole url. NULL urls and those without ``://`` have an empty host and path
    and are judged by the model like any other text (a NULL url as an empty one).
    """
    host, path = url_parts(url_col)
    src = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), model_text(url_col).alias("_lm_text"))
    label, allow = rule_columns(F.col("host"), F.col("path"), rules)
    kept_out = F.pmod(F.crc32(F.col("_lm_text").cast("binary")), F.lit(size.folds)) == 0
    blocks = text_blocks(src.select("page_id", "host", "path", label.alias("rule"), allow.alias("rule_allow"), kept_out.alias("kept_out"), "_lm_text"))
    learned = F.when(~F.col("kept_out"), F.col("rule_allow"))
    grams = stage(count_grams(blocks.select("_lm_text", learned.alias("allow")), size.order), "url-grams")
    scored = stage(score_blocks(blocks, gram_probabilities(grams, size), size.order), "url-scores")
    bins = scored.where("kept_out AND rule_allow IS NOT NULL").groupBy(F.round("score", 2).alias("bin"), "rule_allow").count()
    cut = calibrate([(r["bin"], r["rule_allow"], r["count"]) for r in bins.collect()])  # bounded by the bins
    return scored.select(
        "page_id", "host", "path", "rule", "score",
        F.coalesce(F.col("rule_allow"), F.col("score") >= F.lit(cut)).alias("allow"),
    )
