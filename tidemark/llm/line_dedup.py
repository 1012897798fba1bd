"""Lines that many documents share are kept in one of them.

Texts are split at ``\\n``; a line's key is the line without the white space
``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower case. A key of at least
``min_chars`` code points that at least ``min_documents`` documents hold loses all its
lines except those of the largest document id among its holders; the other lines are
joined again in their order. DataFrame functions only, in two passes:

1. Long lines are exploded and hashed (128 bits). Distinct documents per hash are counted
   by (hash, document) first, so a line that a third of all documents hold is counted in
   many tasks, and by hash after that.
2. The exploded (row, position, hash) rows meet the common hashes; a hash that holds many
   rows is dealt over salts in proportion to its counted rows. The positions that go are
   gathered per row (at most the lines of one text), the text itself moves once, to meet them.

Cases:

* A NULL or empty text is one empty line, which is kept; so is the empty text of a row
  whose lines all go (``n_lines`` - ``n_dropped`` tells them apart).
* A document is an id. Rows that repeat an id are one document: they count once, and all
  of them keep a line that their id is the largest holder of. A line twice in one document
  counts once and stays or goes twice.
* A NULL id is no document: it isn't counted and is no holder that keeps a line, so its
  row loses every common line that other documents hold.
* An empty table gives an empty table. Columns of the input stay, except that the text
  column holds the kept text; ``n_lines`` and ``n_dropped`` replace columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import free_name, spread_join, text_or_empty
from tidemark.session import materialize_observed

BLANKS = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCUMENTS = 40, 5


def _hash(*columns: Column) -> Column:
    """128 bits as two longs, made by two differently seeded hashes."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def long_lines(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(_doc, _row, _at, _line): one row per line of at least ``min_chars``; ``_row`` is a hash of id and
    text (rows that agree in both lose the same lines), ``_at`` the line's position, ``_line`` its key's hash."""
    text = text_or_empty(text_col)
    lines = docs.select(F.col(id_col).alias("_doc"), _hash(text, F.col(id_col)).alias("_row"),
                        F.posexplode(F.split(text, "\n", -1)).alias("_at", "_text"))
    # a line is never shorter than its key: most short ones go before they are trimmed
    keyed = lines.where(F.length("_text") >= min_chars).select("_doc", "_row", "_at", line_key(F.col("_text")).alias("_key"))
    return keyed.where(F.length("_key") >= min_chars).select("_doc", "_row", "_at", _hash(F.col("_key")).alias("_line"))


def common_lines(lines: DataFrame, min_documents: int) -> DataFrame:
    """(_line, _last, _rows) of each key that enough documents hold: its largest document id and number of lines."""
    per_document = lines.groupBy("_line", "_doc").agg(F.count(F.lit(1)).alias("_n"))
    return (per_document.groupBy("_line")
            .agg(F.count("_doc").alias("_documents"), F.max("_doc").alias("_last"), F.sum("_n").alias("_rows"))
            .where(F.col("_documents") >= min_documents).select("_line", "_last", "_rows"))


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept text, ``n_lines`` (before dropping) and ``n_dropped``."""
    lines = long_lines(docs, min_chars, id_col, text_col)
    common, seen = materialize_observed(common_lines(lines, min_documents), total=F.sum("_rows"))
    total = int(seen["total"] or 0)
    row, at, all_lines = free_name(docs, "_lm_row"), free_name(docs, "_lm_at"), free_name(docs, "_lm_lines")
    gone = (
        spread_join(lines, common, "_line", "_rows", total, F.xxhash64("_row", "_at"))
        .where(F.col("_doc").isNull() | (F.col("_doc") != F.col("_last")))
        .groupBy(F.col("_row").alias(row)).agg(F.collect_set("_at").alias(at))
    )
    text = text_or_empty(text_col)
    # the lines move instead of the text, so that it is split once
    met = docs.withColumns({row: _hash(text, F.col(id_col)), all_lines: F.split(text, "\n", -1)}).drop(text_col).join(gone, row, "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.coalesce(at, F.array().cast("array<int>")))
    out = met.withColumns({
        "n_lines": F.size(all_lines).cast("long"),
        "n_dropped": F.coalesce(F.array_size(at), F.lit(0)).cast("long"),
        text_col: F.array_join(F.transform(stays, lambda i: F.get(F.col(all_lines), i)), "\n"),
    })
    return out.select(*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])
