"""Column-expression helpers (all JVM-side built-ins, codegen friendly)."""

from shelfcast.functions.columns import (
    all_not_null,
    clip_floor,
    count_if,
    day_of_week_iso,
    is_finite,
    nonnull_count,
    pct,
    safe_ratio,
)

__all__ = [
    "all_not_null",
    "clip_floor",
    "count_if",
    "day_of_week_iso",
    "is_finite",
    "nonnull_count",
    "pct",
    "safe_ratio",
]
