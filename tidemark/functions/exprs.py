"""Expression builders shared by the operators.

Division is always guarded (``nullif`` on the divisor) because Spark with
ANSI mode raises on a zero divisor where the reference engine returns NULL
or infinity. Percent literals are doubles so results stay DOUBLE rather
than DECIMAL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL when den is 0 or NULL."""
    return _c(num) / F.nullif(_c(den), F.lit(0))


def weighted_mean(score: str | Column, weight: str | Column) -> Column:
    """Aggregate: sum(score * weight) / sum(weight); NULL for zero total weight."""
    s, w = _c(score), _c(weight)
    return safe_ratio(F.sum(s * w), F.sum(w))


def share_pct(hits: str | Column, total: str | Column) -> Column:
    """100 * hits / total as DOUBLE, NULL when total is 0."""
    return safe_ratio(_c(hits) * F.lit(100.0), _c(total))


def value_index(mean: str | Column, total_weight: str | Column) -> Column:
    """Score times log10(1 + total weight); the argument is always >= 1."""
    return _c(mean) * F.log10(F.lit(1.0) + _c(total_weight))


def within_tolerance(a: str | Column, b: str | Column, tol: float = 0.01) -> Column:
    return F.abs(_c(a) - _c(b)) <= F.lit(tol)


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Ordered rule chain: the first failing rule names the reject reason.

    ``rules`` is a list of (reason, failed_condition). NULL means kept.
    A NULL condition counts as not failed.
    """
    out = None
    for reason, failed in rules:
        cond = F.coalesce(failed, F.lit(False))
        out = F.when(cond, F.lit(reason)) if out is None else out.when(cond, F.lit(reason))
    return out if out is not None else F.lit(None).cast("string")


def castable_fails(col: str | Column, to: str, null_fails: bool) -> Column:
    """True when a value cannot be cast to ``to``.

    Integer casts in the reference's checks also fail on a NULL (a missing
    value cannot become an integer), float casts do not.
    """
    c = _c(col)
    bad = c.isNotNull() & c.try_cast(to).isNull()
    return (bad | c.isNull()) if null_fails else bad
