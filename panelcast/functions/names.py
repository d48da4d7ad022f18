"""Rules over column names. They run on the schema, so they never touch data."""

from __future__ import annotations

import re
from collections.abc import Iterable


def matching(columns: Iterable[str], pattern: str) -> list[str]:
    """Names in which ``pattern`` occurs (case-sensitive regex search)."""
    return [c for c in columns if re.search(pattern, c)]


def not_matching(columns: Iterable[str], pattern: str) -> list[str]:
    return [c for c in columns if not re.search(pattern, c)]


def variant_last(columns: Iterable[str], keep: str, family: str) -> list[str]:
    """Drop the ``family`` columns, then append those of them that carry the ``keep`` variant."""
    columns = list(columns)
    return not_matching(columns, family) + matching(columns, keep)


def feature_cols(columns: Iterable[str], exclude: Iterable[str]) -> list[str]:
    excluded = set(exclude)
    return [c for c in columns if c not in excluded]
