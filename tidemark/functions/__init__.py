"""Column-expression helpers: all JVM-side, all inside whole-stage codegen."""

from tidemark.functions.exprs import (
    castable_fails,
    first_reason,
    safe_ratio,
    share_pct,
    value_index,
    weighted_mean,
    within_tolerance,
)

__all__ = [
    "castable_fails",
    "first_reason",
    "safe_ratio",
    "share_pct",
    "value_index",
    "weighted_mean",
    "within_tolerance",
]
