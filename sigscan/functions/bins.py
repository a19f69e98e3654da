"""Bins of p-values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH, BINS, OVERFLOW = 0.001, 50, 51


def normalize_operator(op: Column) -> Column:
    """"<", "=", ">" for their spellings; anything else is "other"."""
    return F.when(op.isin("<", "≤", "less than", "of <"), "<").when(op.isin(">", "≥"), ">").when(op.isin("=", "of"), "=").otherwise("other")


def bin_index(p: Column) -> Column:
    """Right-closed thousandths 1..50 up to 0.05, 51 above."""
    inside = F.least(F.lit(BINS), F.greatest(F.lit(1), F.ceil(p / F.lit(WIDTH)).cast("int")))
    return F.when(p <= F.lit(WIDTH * BINS), inside).otherwise(F.lit(OVERFLOW))


def bin_label(index: Column) -> Column:
    """A bin's upper edge with three decimals, e.g. 0.001."""
    return F.concat(F.lit("0."), F.lpad(index.cast("string"), 3, "0"))


def histogram_bin(p: Column) -> Column:
    """Bin 0..49 of edges k * 0.001 + 1e-12, half-open, the last closed; null outside."""
    edge = lambda k: k * F.lit(0.001) + F.lit(0.000000000001)
    guess = F.floor(p / F.lit(0.001)).cast("int")
    # the floor is at most one bin off; the edges decide
    k = F.when(p < edge(guess), guess - 1).when(p >= edge(guess + 1), guess + 1).otherwise(guess)
    last = edge(F.lit(BINS))
    return F.when((p >= edge(F.lit(0))) & (p < last), k).when(p == last, F.lit(BINS - 1))
