"""Language-model scoring with an Elias-Fano n-gram trie.

The model interpolates bigrams, discounted by a constant, with add-one unigrams:
``p(w | v) = max(c(v, w) - D, 0) / c(v) + D n(v) / c(v) * (c(w) + 1) / (N + V + 1)``,
with ``n(v)`` the number of different followers of ``v``. Each document is its
words and one end token; the first word follows a start mark.

Trie shards hold two levels. Level 1: the words (hashes) as an Elias-Fano
sequence, with their quantised unigram probability and back-off weight and an
Elias-Fano sequence of pointers into level 2. Level 2: the followers of each
word, made monotone by the rank of the word before, with their quantised
discounted probability. A query finds the word by successor search and then the
follower by successor search relative to that context. Shards are files in the
shared folder and are memory-mapped where that is a mounted path.

How it scales: the corpus is coded once into chunks of about ``CHUNK`` tokens.
Chunks send their distinct words and bigrams, packed, to groups by the hash of
the word (context). A group merges the counts of its range, writes its shard, and
answers each chunk's bigrams from it; the answers go back to the chunks, which add
up their documents. A context that holds a large share of the tokens is dealt over
several groups by its followers. Groups and chunks have a bounded size at any size of
the corpus, and the driver sees sums and the list of those frequent contexts (at
most 8 a group).

Followers are told apart by 32 bits of their hash: an unseen bigram is taken for a seen
one with a probability of ``n(v) / 2**32``. Probabilities are kept in steps of 2**-9 of a
decimal logarithm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import elias_fano as ef
from tidemark.llm.shared import shared_path, slices, stage, string_buffer, text_or_empty
from tidemark.llm.words import mix, word_hashes

CHUNK = 2_000_000
GROUP_TOKENS = 4_000_000
SLICE_BYTES = 2 << 20
END = np.uint64(0xE0D0_0000_0000_0001)
START = np.uint64(0x57A2_0000_0000_0003)
STEP = 512  # quantisation: codes a decimal logarithm
NONE, HOT = 65535, 65534


def _codes(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEP), HOT - 1).astype("<u2")


def _values(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** (codes.astype(float) / -STEP)


class Sizes(NamedTuple):
    """Of the whole corpus: training tokens, distinct ones, training documents, and the groups' bits."""

    tokens: int
    distinct: int
    docs: int
    bits: int


class Frequent(NamedTuple):
    """Contexts dealt over several groups: sorted hashes, their counts and numbers of groups."""

    words: np.ndarray
    counts: np.ndarray
    parts: np.ndarray

    def find(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)


# ---- chunks ------------------------------------------------------------------

CHUNK_SCHEMA = ("chunk long, doc_ids array<long>, held binary, ends binary, vocabulary binary, low binary, middle binary, high binary, "
                "n_tokens long, n_train long, n_train_docs long")


def _chunk_row(chunk: int, ids: list, held: np.ndarray, hashes: list[np.ndarray], lengths: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(lengths + 1)
    tokens = np.full(int(ends[-1]), END, np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[ends - 1] = False
    tokens[inner] = np.concatenate(hashes)
    words, at, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which pack well
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    codes = rank[at]
    train = np.repeat(~held, lengths + 1)
    planes = [((codes >> s) & 255).astype(np.uint8).tobytes() for s in (0, 8, 16)]
    cells = [chunk, ids, held.tobytes(), ends.astype("<i8").tobytes(), words[order].tobytes(), *planes,
             len(tokens), int(train.sum()), int((~held).sum())]
    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6, *[pa.int64()] * 3]
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=names)


def code_chunks(docs: DataFrame, held: Column, chunk_tokens: int = CHUNK) -> DataFrame:
    """The corpus as coded chunks, written to the shared folder."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), text_or_empty("text").alias("_lm_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 24
        ids, flags, hashes, lengths, size = [], [], [], [], 0
        for batch in slices(batches, 2, SLICE_BYTES):
            h, row = word_hashes(*string_buffer(batch.column(2)))
            ids += batch.column(0).to_pylist()
            flags += batch.column(1).to_pylist()
            hashes.append(h)
            lengths.append(np.bincount(row, minlength=batch.num_rows))
            size += len(h) + batch.num_rows
            if size >= chunk_tokens:
                yield _chunk_row(serial, ids, np.array(flags, bool), hashes, np.concatenate(lengths))
                serial += 1
                ids, flags, hashes, lengths, size = [], [], [], [], 0
        if ids:
            yield _chunk_row(serial, ids, np.array(flags, bool), hashes, np.concatenate(lengths))

    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "chunks")
    src.mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(CHUNK_SCHEMA).parquet(path)


class Chunk:
    """The arrays of one chunk row."""

    def __init__(self, row: dict[str, pa.Scalar]):
        raw = {k: np.frombuffer(row[k].as_buffer(), np.uint8) for k in ("held", "ends", "vocabulary", "low", "middle", "high")}
        self.id = row["chunk"].as_py()
        self.held, self.ends, self.vocabulary = raw["held"].view(bool), raw["ends"].view("<i8"), raw["vocabulary"].view(np.uint64)
        self.tokens = raw["low"].astype(np.int64) | raw["middle"].astype(np.int64) << 8 | raw["high"].astype(np.int64) << 16
        self.lengths = np.diff(np.r_[0, self.ends])
        self.train = np.repeat(~self.held, self.lengths)

    def by_word_group(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary's order by hash and where each group begins in it."""
        order = np.argsort(self.vocabulary)
        top = (self.vocabulary[order] >> np.uint64(64 - bits)).astype(np.int64)
        return order, np.searchsorted(top, np.arange((1 << bits) + 1))

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Per token the code of its bigram: the word before (the vocabulary's size for the start), then the word."""
        before = np.r_[0, self.tokens[:-1]]
        before[np.r_[0, self.ends[:-1]]] = len(self.vocabulary)
        return before * (len(self.vocabulary) + 1) + self.tokens, before

    def bigram_groups(self, keys: np.ndarray, bits: int, frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
        """The group of each distinct bigram, and the stable order by group."""
        contexts = np.r_[self.vocabulary, START]
        v, w = np.divmod(keys, len(self.vocabulary) + 1)
        group = (contexts >> np.uint64(64 - bits)).astype(np.int64)[v]
        hot = frequent.find(contexts)[v]
        dealt = np.flatnonzero(hot >= 0)
        if len(dealt):
            part = mix(self.vocabulary[w[dealt]]) % frequent.parts[hot[dealt]].astype(np.uint64)
            group[dealt] = (group[dealt] + part.astype(np.int64)) % (1 << bits)
        return group, np.argsort(group.astype(np.uint16 if bits <= 16 else np.int64), kind="stable")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}


# ---- words -------------------------------------------------------------------

REPLY_SCHEMA = "chunk long, kind int, part int, payload binary"


def _reply(chunk: list[int], kind: int, part: int, payload: list[bytes]) -> pa.Table:
    n = len(chunk)
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()),
                     "payload": pa.array(payload, pa.binary())})


def count_words(chunks: DataFrame, bits: int, often: int) -> DataFrame:
    """Replies of kind 1: for each chunk and group the training counts of its words (uint32, by
    hash); of kind 2: the number of distinct words and the words counted at least ``often`` times."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row)
            counts = np.bincount(c.tokens[c.train], minlength=len(c.vocabulary))
            order, cuts = c.by_word_group(bits)
            words, counts = c.vocabulary[order], counts[order].astype("<u4")
            for g, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([c.id]), pa.array([g], pa.int32()), pa.array([words[a:b].tobytes()]), pa.array([counts[a:b].tobytes()])],
                                                     names=["chunk", "part", "words", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        words = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("words")]
        counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("counts")])
        distinct, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, counts, minlength=len(distinct)).astype(np.int64)
        cuts = np.cumsum([0, *map(len, words)])
        answers = [np.minimum(total[at[a:b]], 2**32 - 1).astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])]
        part, top = table.column("part")[0].as_py(), np.flatnonzero((total >= often) & (distinct != END))
        summary = np.int64([(total > 0).sum()]).tobytes() + distinct[top].tobytes() + total[top].tobytes()
        return pa.concat_tables([_reply(table.column("chunk").to_pylist(), 1, part, answers), _reply([-1], 2, part, [summary])])

    sent = chunks.select("chunk", "held", "ends", "vocabulary", "low", "middle", "high").mapInArrow(send, "chunk long, part int, words binary, counts binary")
    return stage(sent.groupBy("part").applyInArrow(merge, REPLY_SCHEMA), "word-counts")


# ---- the trie ----------------------------------------------------------------


def pack_shard(words: np.ndarray, unigram: np.ndarray, back_off: np.ndarray, first: np.ndarray, followers: np.ndarray, probability: np.ndarray) -> bytes:
    """A shard's flat layout. ``first``: where each word's followers begin (and the end)."""
    n = len(words)
    rank = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    monotone = (rank << np.uint64(32)) | followers.astype(np.uint64)
    parts = [ef.pack(words, 1 << 64), ef.pack(first.astype(np.uint64), int(first[-1]) + 1), ef.pack(monotone, max(1, n) << 32)]
    for codes in (unigram, back_off, probability):
        data = codes.astype("<u2").tobytes()
        parts.append(data.ljust(-(-len(data) // 8) * 8, b"\0"))
    return b"".join(parts)


class Shard:
    """A trie shard over a flat (memory-mapped) buffer."""

    def __init__(self, buffer: np.ndarray):
        self.words = ef.Sequence(buffer)
        self.first = ef.Sequence(buffer, self.words.end)
        self.followers = ef.Sequence(buffer, self.first.end)
        at, n, m = self.followers.end, self.words.n, self.followers.n
        take = lambda at, n: buffer[at : at + 2 * n].view("<u2")
        step = -(-2 * n // 8) * 8
        self.unigram, self.back_off, self.probability = take(at, n), take(at + step, n), take(at + 2 * step, m)

    @classmethod
    def open(cls, path: str) -> Shard:
        store, name = _store(path)
        if isinstance(store, fs.LocalFileSystem):
            return cls(np.frombuffer(pa.memory_map(name).read_buffer(), np.uint8))
        with store.open_input_file(name) as f:
            return cls(np.frombuffer(f.read_buffer(), np.uint8))

    def lookup(self, contexts: np.ndarray, repeats: np.ndarray, followers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the back-off weight for each context and of the probability for each of its
        followers (``repeats`` of them); NONE where a context or follower is unknown."""
        rank = self.words.find(contexts)
        back_off = np.where(rank >= 0, self.back_off[rank] if self.words.n else NONE, NONE).astype("<u2")
        of = np.repeat(rank, repeats)
        known = np.flatnonzero(of >= 0)
        out = np.full(len(followers), NONE, "<u2")
        if len(known):
            at = self.followers.find((of[known].astype(np.uint64) << np.uint64(32)) | followers[known].astype(np.uint64))
            begin, end = self.first.access(of[known]).astype(np.int64), self.first.access(of[known] + 1).astype(np.int64)
            seen = (at >= begin) & (at < end)
            out[known[seen]] = self.probability[at[seen]]
        return back_off, out


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and ":/" in path:  # file:/x
        path = path.replace(":/", ":///", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _write(path: str, data: bytes) -> str:
    """Write a shard under a name of this attempt's own."""
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    name = f"{root}/shard-{uuid.uuid4().hex}"
    with store.open_output_stream(name, compression=None) as f:
        f.write(data)
    return f"{path}/{name.rsplit('/', 1)[1]}"


def _follower(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(0xFFFFFFFF)).astype("<u4")


def _packed(contexts: np.ndarray, runs: np.ndarray, followers: np.ndarray, counts: np.ndarray) -> bytes:
    many = np.flatnonzero(counts >= 255)
    head = np.array([len(contexts), len(followers), len(many)], "<i8").tobytes()
    return b"".join([head, contexts.tobytes(), runs.astype("<u4").tobytes(), followers.tobytes(), np.c_[many, counts[many]].astype("<u4").tobytes(),
                     np.minimum(counts, 255).astype(np.uint8).tobytes()])


def _unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m, k = (int(x) for x in data[:24].view("<i8"))
    cuts = np.cumsum([24, 8 * n, 4 * n, 4 * m, 8 * k, m])
    contexts, runs, followers, many, counts = (data[a:b] for a, b in zip(cuts, cuts[1:]))
    counts = counts.astype(np.int64)
    many = many.view("<u4").reshape(-1, 2)
    counts[many[:, 0]] = many[:, 1]
    return contexts.view(np.uint64), runs.view("<u4").astype(np.int64), followers.view("<u4"), counts


def build_shard(contexts: np.ndarray, runs: np.ndarray, followers: np.ndarray, counts: np.ndarray, sizes: Sizes, frequent: Frequent) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A shard from bigram counts (repeated ones add up): its bytes, and for contexts that
    lie in several shards their hashes and this shard's share of the back-off weight."""
    words, at = np.unique(contexts, return_inverse=True)
    key = (np.repeat(at.astype(np.uint64), runs) << np.uint64(32)) | followers.astype(np.uint64)
    order = np.argsort(key)
    key, counts = key[order], counts[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    counts = np.add.reduceat(counts, first) if len(key) else counts
    key, counts = key[first][counts > 0], counts[counts > 0]  # the rest are only asked for
    of = (key >> np.uint64(32)).astype(np.int64)
    total, different = np.bincount(of, counts, minlength=len(words)), np.bincount(of, minlength=len(words))
    hot = frequent.find(words)
    if len(frequent.words):
        total = np.where(hot >= 0, frequent.counts[hot], total)
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
    live = different > 0
    weight = discount * different[live] / total[live]
    codes = np.where(hot[live] >= 0, HOT, _codes(np.minimum(weight, 1)))
    unigram = _codes((total[live] + 1) / (sizes.tokens + sizes.distinct + 1))
    data = pack_shard(words[live], unigram, codes, np.r_[0, np.cumsum(different[live])], key & np.uint64(0xFFFFFFFF),
                      _codes((counts - discount) / total[of]) if len(key) else np.empty(0, "<u2"))
    parted = hot[live] >= 0
    return data, words[live][parted], weight[parted]


def count_bigrams(chunks: DataFrame, sizes: Sizes, frequent: Frequent, path: str) -> DataFrame:
    """Build and write the shards and answer the chunks. Replies of kind 3: for each chunk and
    group the codes of the back-off weights and probabilities; of kind 4: the back-off
    shares of contexts in several groups."""
    shared = chunks.sparkSession.sparkContext.broadcast(frequent)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row)
            keys, _ = c.bigrams()
            flagged = np.sort(keys * 2 + ~c.train)
            keys = flagged >> 1
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            counts = np.add.reduceat(1 - (flagged & 1), first)
            keys = keys[first]
            group, order = c.bigram_groups(keys, sizes.bits, shared.value)
            v, w = np.divmod(keys[order], len(c.vocabulary) + 1)
            contexts, followers, counts = np.r_[c.vocabulary, START], _follower(c.vocabulary)[w], counts[order]
            cuts = np.searchsorted(group[order], np.arange((1 << sizes.bits) + 1))
            for g, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    begin = np.flatnonzero(np.r_[True, v[a + 1 : b] != v[a : b - 1]])
                    data = _packed(contexts[v[a:b][begin]], np.diff(np.r_[begin, b - a]), followers[a:b], counts[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array([c.id]), pa.array([g], pa.int32()), pa.array([data])], names=["chunk", "part", "bigrams"])

    def merge(table: pa.Table) -> pa.Table:
        sent = [_unpacked(np.frombuffer(x.as_buffer(), np.uint8)) for x in table.column("bigrams")]
        data, hot, shares = build_shard(*(np.concatenate(x) for x in zip(*sent)), sizes, shared.value)
        shard = Shard.open(_write(path, data))
        answers = []
        for contexts, runs, followers, _ in sent:
            back_off, probability = shard.lookup(contexts, runs, followers)
            answers.append(np.int64([len(back_off)]).tobytes() + back_off.tobytes() + probability.tobytes())
        part = table.column("part")[0].as_py()
        return pa.concat_tables([_reply(table.column("chunk").to_pylist(), 3, part, answers), _reply([-1], 4, part, [hot.tobytes() + shares.tobytes()])])

    sent = chunks.select("chunk", "held", "ends", "vocabulary", "low", "middle", "high").mapInArrow(send, "chunk long, part int, bigrams binary")
    return stage(sent.groupBy("part").applyInArrow(merge, REPLY_SCHEMA), "bigrams")


# ---- scores ------------------------------------------------------------------

SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_corpus(docs: DataFrame, held: Column, chunk_tokens: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-one unigrams) and score (the model's log10 probability of the text with its end).

    The model learns from the rows where ``held`` is not true. A NULL text is empty
    and has the end token only; a NULL doc_id is scored and trains like any other."""
    spark = docs.sparkSession
    chunks = code_chunks(docs, held, chunk_tokens)
    totals = chunks.agg(F.sum("n_tokens").alias("all"), F.sum("n_train").alias("train"), F.sum("n_train_docs").alias("docs")).first()
    if totals["all"] is None:
        return spark.createDataFrame([], SCORE_SCHEMA)
    bits = max(2, min(16, int(np.ceil(np.log2(totals["all"] / GROUP_TOKENS)))))
    often = max(1000, totals["train"] // (8 << bits))
    counted = count_words(chunks, bits, often)
    distinct, hot, counts = 0, [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for r in counted.where("kind = 2").select("payload").collect():  # a number and at most 8 words a group
        raw = np.frombuffer(r["payload"], np.int64)
        distinct, n = distinct + int(raw[0]), (len(raw) - 1) // 2
        hot.append(raw[1 : 1 + n].view(np.uint64))
        counts.append(raw[1 + n :])
    if totals["docs"] >= often:
        hot.append(np.array([START]))
        counts.append(np.array([totals["docs"]]))
    hot, counts = np.concatenate(hot), np.concatenate(counts)
    order = np.argsort(hot)
    frequent = Frequent(hot[order], counts[order], np.minimum(1 << bits, -(-counts[order] // often) * 2))
    sizes = Sizes(totals["train"], distinct, totals["docs"], bits)
    answered = count_bigrams(chunks, sizes, frequent, shared_path(spark, "trie"))
    back_off = np.zeros(len(frequent.words))
    for r in answered.where("kind = 4").select("payload").collect():
        raw = np.frombuffer(r["payload"], np.uint64)
        back_off[frequent.find(raw[: len(raw) // 2])] += raw[len(raw) // 2 :].view(np.float64)
    shared = spark.sparkContext.broadcast((frequent, back_off))

    def add_up(table: pa.Table) -> pa.Table:
        rows = table.to_batches()
        cells = {(r["kind"].as_py(), r["part"].as_py()): r for r in _rows(rows)}
        row = cells[0, 0]
        c = Chunk(row)
        frequent, hot_weight = shared.value
        order, cuts = c.by_word_group(sizes.bits)
        known = np.empty(len(order), np.int64)
        for g in np.flatnonzero(np.diff(cuts)):
            known[order[cuts[g] : cuts[g + 1]]] = np.frombuffer(cells[1, g]["payload"].as_buffer(), "<u4")
        unigram = (known + 1) / (sizes.tokens + sizes.distinct + 1)
        token_keys, _ = c.bigrams()
        keys = np.unique(token_keys)
        group, by_group = c.bigram_groups(keys, sizes.bits, frequent)
        v, w = np.divmod(keys, len(c.vocabulary) + 1)
        weight_code, code = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        cuts = np.searchsorted(group[by_group], np.arange((1 << sizes.bits) + 1))
        for g in np.flatnonzero(np.diff(cuts)):
            mine = by_group[cuts[g] : cuts[g + 1]]
            raw = np.frombuffer(cells[3, g]["payload"].as_buffer(), np.uint8)
            n = int(raw[:8].view(np.int64)[0])
            codes = raw[8:].view("<u2")
            run = np.cumsum(np.r_[False, v[mine][1:] != v[mine][:-1]])
            weight_code[mine], code[mine] = codes[:n][run], codes[n:]
        weight = np.where(weight_code == NONE, 1.0, _values(weight_code))
        at = frequent.find(np.r_[c.vocabulary, START])[v]
        if len(frequent.words):
            weight = np.where(at >= 0, hot_weight[at], weight)
        p = np.minimum(1.0, np.where(code == NONE, 0.0, _values(code)) + weight * unigram[w])
        doc = np.repeat(np.arange(len(c.ends)), c.lengths)
        n = len(c.ends)
        score = np.bincount(doc, np.log10(p)[np.searchsorted(keys, token_keys)], minlength=n)
        return pa.table({
            "doc_id": pa.array(row["doc_ids"].as_py(), pa.int64()), "held_out": pa.array(c.held), "n_tokens": pa.array(c.lengths.astype(np.int64)),
            "n_known": pa.array(np.bincount(doc, known[c.tokens] > 0, minlength=n).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, sizes.tokens, np.int64)), "base_score": pa.array(np.bincount(doc, np.log10(unigram)[c.tokens], minlength=n)),
            "score": pa.array(score)})

    own = ["doc_ids", "held", "ends", "vocabulary", "low", "middle", "high"]
    left = chunks.select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("part"), F.lit(None).cast("binary").alias("payload"), *own)
    replies = counted.unionAll(answered).where("kind IN (1, 3)")
    right = replies.select("chunk", "kind", "part", "payload", *(F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in own))
    return left.unionAll(right).groupBy("chunk").applyInArrow(add_up, SCORE_SCHEMA)
