"""Personal data by weak supervision.

Candidate spans of each kind come from wide patterns. Six labelers (strict form,
structure, boundaries, context words, gazetteers, neighbouring digits) vote yes,
no or abstain on each. The votes of all candidates of all rows are counted by
pattern in Spark (at most 3**6 rows a kind); expectation-maximisation over these
counts estimates each labeler's reliability, and the posteriors train a logistic
span classifier. A span is kept when the classifier says so or when it is one of
the plain base spans, which always stay.

Both passes are maps over whole texts; only the pattern counts are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import text_or_empty

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
N_VOTES = 6
CONTEXT = 28  # code points before a span in which words count

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![\w+.\-(])\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}(?![\w\-]|\.\w)")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{24,128}(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORDS = re.compile(r"[^\W\d_]+")

# Gazetteers: words before a span and parts of it that speak for a kind, or against any.
_TLDS = frozenset("com net org edu gov mil int io co uk de fr es it nl eu us ca au ch at be se no dk fi pl pt ru jp cn in br mx info biz dev app ai me".split())
_FOR = {
    "email": frozenset("email mail e contact write courriel correo write to".split()),
    "ip": frozenset("ip address host server client addr adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit payment iban account carte tarjeta karte".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax contact téléphone telefon teléfono llame".split()),
    "secret": frozenset("token key secret password passwd apikey api bearer auth pwd".split()),
}
_AGAINST = frozenset("version release section chapter figure isbn issn doi page article order invoice sha commit md5 checksum digest revision".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _octets(span: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in span.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain patterns, leftmost without overlap per kind, checked once."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in _EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """The base spans and the wider ones that the model decides on."""
    out = base_spans(text)
    have = set(out)
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(_NOT_DIGIT.sub("", m[0])) <= 19:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
    out += [(4, m.start(), m.end()) for m in _SECRET.finditer(text)]
    return [*have, *(c for c in dict.fromkeys(out) if c not in have)]


def votes(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """The six labelers' votes: 1 yes, -1 no, 0 abstain."""
    span, name = text[start:end], KINDS[kind]
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    digits = _NOT_DIGIT.sub("", span)
    form = structure = gazetteer = 0
    if name == "email":
        local, _, domain = span.partition("@")
        tld = domain.rsplit(".", 1)[-1].lower()
        form = 1 if 2 <= len(tld) <= 24 and tld.isalpha() else -1
        structure = -1 if local.startswith(".") or ".." in span or domain.startswith("-") else 1
        gazetteer = 1 if tld in _TLDS else 0
    elif name == "ip":
        parts = span.split(".")
        form = 1 if all(p == "0" or not p.startswith("0") for p in parts) else -1
        structure = -1 if after == "." and text[end + 1 : end + 2].isdigit() else 1
        gazetteer = -1 if parts[0] == "0" or set(map(len, parts)) == {1} else 1
    elif name == "card":
        valid = luhn(digits)  # a number whose check digit is wrong has neither form nor issuer
        form = 1 if valid and len(digits) in (15, 16) else -1
        structure = 1 if valid else -1
        gazetteer = (1 if digits[0] in "3456" else 0) if valid else -1
    elif name == "phone":
        form = 1 if 10 <= len(digits) <= 13 else -1
        structure = 1 if span[0] == "+" or "(" in span else 0
        gazetteer = 1 if span.startswith(("+1 ", "+1(", "+33", "+34", "+44", "+49", "(")) else 0
    else:
        form = 1 if len(span) in (32, 40, 48, 56, 64, 96, 128) else -1
        structure = 1 if len(set(span.lower())) >= 10 else -1
        gazetteer = 1 if before in "\"'=:" and before else 0
    boundary = -1 if (before.isalnum() or after.isalnum()) else 1
    words = {w.lower() for w in _WORDS.findall(text[max(0, start - CONTEXT) : start])}
    context = 1 if words & _FOR[name] else -1 if words & _AGAINST else 0
    near = text[max(0, start - 2) : start] + text[end : end + 2]
    alone = -1 if any(c.isdigit() for c in near) else 1
    return form, structure, boundary, context, gazetteer, alone


class SpanModel(NamedTuple):
    """Weights of the span classifier by kind, labeler and vote, and a bias by kind."""

    weights: np.ndarray  # [kind, labeler, vote + 1]
    bias: np.ndarray

    def probability(self, kind: int, vote: tuple[int, ...]) -> float:
        s = self.bias[kind] + sum(self.weights[kind, j, v + 1] for j, v in enumerate(vote))
        return float(1 / (1 + np.exp(-np.clip(s, -40, 40))))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for one kind: posteriors of the patterns and the
    labelers' vote probabilities ``[true class, labeler, vote + 1]``."""
    n, m = patterns.shape
    post = np.clip(0.5 + patterns.sum(1) / (2.0 * m), 0.05, 0.95)
    one_hot = patterns[:, :, None] == np.array([-1, 0, 1])
    rely = np.empty((2, m, 3))
    for _ in range(rounds):
        for c, w in ((0, counts * (1 - post)), (1, counts * post)):
            tally = (w[:, None, None] * one_hot).sum(0) + np.array([[2.0, 1, 1], [1, 1, 2.0]][c])
            rely[c] = tally / tally.sum(1, keepdims=True)
        prior = ((counts * post).sum() + 2) / (counts.sum() + 3)  # most candidates of a wide pattern are right
        logs = [np.log(rely[c])[None].repeat(n, 0)[one_hot].reshape(n, m).sum(1) for c in (0, 1)]
        odds = logs[1] - logs[0] + np.log(prior / max(1e-9, 1 - prior))
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return post, rely


def fit(rows: list[tuple[int, tuple[int, ...], int]]) -> SpanModel:
    """The span classifier from (kind, votes, count); kinds without candidates keep zero weights."""
    weights, bias = np.zeros((len(KINDS), N_VOTES, 3)), np.zeros(len(KINDS))
    for kind in range(len(KINDS)):
        mine = sorted((v, n) for k, v, n in rows if k == kind)
        if not mine:
            continue
        patterns, counts = np.array([v for v, _ in mine]), np.array([n for _, n in mine], float)
        post, _ = estimate(patterns, counts)
        x = (patterns[:, :, None] == np.array([-1, 0, 1])).reshape(len(mine), -1).astype(float)
        x = np.c_[x, np.ones(len(mine))]
        share = counts / counts.sum()
        w = np.zeros(x.shape[1])
        for _ in range(400):  # logistic regression on the posteriors
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            w -= 0.5 * (x.T @ (share * (p - post)) + 1e-3 * w)
        weights[kind], bias[kind] = w[:-1].reshape(N_VOTES, 3), w[-1]
    return SpanModel(weights, bias)


def train(docs: DataFrame) -> SpanModel:
    """Count the vote patterns of every candidate of every row and fit the model."""
    src = docs.select(text_or_empty("text").alias("_lm_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                text = x.as_py()
                for kind, start, end in candidates(text):
                    seen[kind, votes(text, kind, start, end)] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in seen], pa.int32()), pa.array([list(v) for _, v in seen], pa.list_(pa.int32())),
             pa.array(list(seen.values()), pa.int64())], names=["kind", "votes", "n"]
        )

    rows = src.mapInArrow(run, "kind int, votes array<int>, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    return fit([(r["kind"], tuple(r["votes"]), r["n"]) for r in rows.collect()])  # at most 3**6 patterns a kind


def find(text: str, model: SpanModel, threshold: float = 0.5) -> tuple[list, list]:
    """Base spans, and all spans: the base ones and those which the model adds
    (an added span never overlaps another)."""
    base = sorted(base_spans(text))
    kept, taken = list(base), sorted((s, e) for _, s, e in base)
    known = set(base)
    for kind, start, end in sorted(candidates(text), key=lambda c: (c[1], -c[2], c[0])):
        if (kind, start, end) in known or any(s < end and start < e for s, e in taken):
            continue
        if model.probability(kind, votes(text, kind, start, end)) >= threshold:
            kept.append((kind, start, end))
            taken.append((start, end))
    return base, sorted(kept)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def span_finder(spark: SparkSession, model: SpanModel) -> Callable[[Column], Column]:
    """A function from a text column (no NULLs) to a struct of ``base_spans``, ``spans`` (arrays of kind, start,
    end in code points, by kind then start) and ``masked`` (each span replaced by its kind in angle brackets)."""
    shared = spark.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("base_spans", SPANS), T.StructField("spans", SPANS), T.StructField("masked", T.StringType())])

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        as_rows = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans]
        out = []
        for text in texts:
            base, spans = find(text, shared.value)
            out.append((as_rows(base), as_rows(spans), mask(text, spans)))
        return pd.DataFrame(out, columns=["base_spans", "spans", "masked"])

    return run


def add_spans(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``doc_id`` and ``text`` of ``docs`` plus the fields of ``span_finder``. NULL texts have no spans
    and an empty masked text."""
    found = span_finder(docs.sparkSession, model)(text_or_empty("text"))
    return docs.select("doc_id", "text", found.alias("f")).select("doc_id", "text", "f.base_spans", "f.spans", "f.masked")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with the spans replaced; overlapping spans of different kinds become one."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
