"""Deterministic draws: a pure function of the key, the same on any partitioning.

Single draws differ from a Mersenne Twister seeded with the same numbers; the
distribution is the same uniform one.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uniform(*key) -> Column:
    """u in [0, 1) from the first 32 bits of md5('a|b|...').

    Integers are literals (seeds), strings are column names.
    """
    parts = [F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k for k in key]
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def pick_index(n: Column, *key) -> Column:
    """1-based index drawn uniformly from 1..n."""
    return (F.floor(uniform(*key) * n) + 1).cast("bigint")
