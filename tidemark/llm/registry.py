"""Registered queries of this package and, where SQL can express one, its DuckDB SQL.

Each ``opN_<name>`` applies its operator to the whole intended table with
production parameters and derives the result's columns from the operator's output.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import cap_filters, decontaminate, html_paths, line_dedup, minhash, ngram_trie, packing, pii, quality, run_catcher, url_filter, warc, whitening
from tidemark.llm.shared import ship_package

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
URL_RULES = (
    url_filter.Rule(True, "com", "/"),
    url_filter.Rule(False, "example.com", "/en/"),
    url_filter.Rule(True, "www.example.com", "/en/"),
    url_filter.Rule(False, "net", "/es/"),
    url_filter.Rule(False, "net", "/fr/"),
)
QUALITY_CUT = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by tag-path ratios."""
    return html_paths.extract_pages(table(spark, sf_dir, "pages"))


def op2_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the best occurrence."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under an n-gram trie learned from the rest of a fold."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return ngram_trie.score_corpus(table(spark, sf_dir, "documents"), held)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: path rules, else the character-model ratio."""
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("allow"), "allow").otherwise("block").alias("verdict"), "score")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document by consistent weighted sampling."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives with revisits and read back by byte ranges."""
    back = warc.archive_round_trip(table(spark, sf_dir, "pages"), keep_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of a label with a cosine of 0.98 or more."""
    return cap_filters.link_vectors(table(spark, sf_dir, "embeddings"))


def pii_digest(found: DataFrame) -> DataFrame:
    """The digest columns of ``pii.add_spans`` output."""
    joined = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.BASE_KINDS],
        F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal-data spans of every text: base patterns plus the weakly supervised model's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_digest(pii.add_spans(docs, pii.train(docs)))


def train_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Ranker:
    """The ranker from the labelled rows of ``docs`` outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~quality.is_held_out())
    return quality.train(docs.select("doc_id", "text"), labels)


def op9_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from pairwise preferences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.add_score(docs, train_quality(spark, docs, sf_dir))
    return scored.select(
        "doc_id", quality.is_held_out().alias("held_out"), "score", F.when(F.col("score") >= QUALITY_CUT, 1).otherwise(0).alias("predicted")
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces packed into sequences of at most 1024 ids."""
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), TOKENIZER, keep_ids=False)
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight leading whitened components of every vector, by contour integration."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 8)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many documents share (the last holder keeps them)."""
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
),
c AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (
  SELECT k.r, k.doc_id, k.line, k.pos, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last_doc AS gone
  FROM k LEFT JOIN c ON c.key = k.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY r
"""


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text); in a tenth of them (by a checksum of the id) the words from some
    place on repeat a stretch of themselves. A NULL id has no checksum: its text stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.where(h % 10 == 0).withColumn("_w", words).withColumns({"_g": F.floor(h / 10), "_n": F.size("_w").cast("long")})
    a = chosen.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    p = a.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    i, start, period = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), F.col("_a"), F.col("_p")
    source = lambda k: F.when(k < start, k).otherwise(start + (k - start) % period).cast("int")
    repeated = F.array_join(F.transform(i, lambda k: F.get(F.col("_w"), source(k))), " ")
    return p.select("doc_id", F.when(F.col("_n") > 0, repeated).otherwise(F.lit("")).alias("text")).unionAll(
        docs.where(h.isNull() | (h % 10 != 0)).select("doc_id", "text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic word runs of every document: the one of greatest exponent, digests of all runs and of the collapsed text."""
    found = run_catcher.find_runs(with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # exponents compare exactly: a / p > b / q when a * q > b * p
    ahead = lambda r, s: (r["length"] * s["period"] > s["length"] * r["period"]) | (
        (r["length"] * s["period"] == s["length"] * r["period"]) & ((r["start"] < s["start"]) | ((r["start"] == s["start"]) & (r["period"] < s["period"]))))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda s, r: F.when(ahead(r, s), r).otherwise(s))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _query(f)
    for f in (op1_html_paths, op2_cgk_decontamination, op3_elias_fano_lm, op4_url_filter, op5_minhash_near_dedup, op6_warc_records, op7_cap_filters, op8_pii_spans, op9_quality_ranker, op10_best_fit_packing, op11_feast_whitening, op12_line_dedup, op13_periodic_runs)
}
ORACLE: dict[str, str] = {"op12_line_dedup": OP12_SQL}
