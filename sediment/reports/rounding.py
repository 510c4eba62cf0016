"""Rounding of figures for output, by the name of the figure."""

from __future__ import annotations

# Digits after the point.
DIGITS = {
    "fill_rate": 4,
    "cardinality": 4,
    "mean_length": 1,
    "placeholder_rate": 4,
    "parse_rate": 4,
    "monotonic": 4,
    "score": 4,
    "span_s": 3,
    "mean_size": 2,
    "p95_size": 2,
    "span_days": 3,
    "own_days": 4,
    "own_rate": 3,
    "median_gap_s": 2,
    "rate_per_day": 3,
    "reuse": 3,
    "mean_words": 1,
    "untemplatable_share": 4,
    "redaction_share": 4,
    "coverage": 4,
}


def rounded(x, name: str | None = None):
    """x, of maps and lists, with its figures rounded, halves to even."""
    if isinstance(x, dict):
        return {k: rounded(v, k) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [rounded(v, name) for v in x]
    return round(x, DIGITS[name]) if isinstance(x, float) and name in DIGITS else x
