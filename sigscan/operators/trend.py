"""Yearly prevalence of p-values by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigscan.functions.categories import CATEGORIES, TREND_YEARS

#: Output column of each significance threshold; operators are ignored.
THRESHOLDS = {"le_05": 0.05, "le_01": 0.01, "le_005": 0.005, "le_001": 0.001}


def with_least(df: DataFrame, pvalues: str = "pv") -> DataFrame:
    """Replace the match list by what trends need of it: its least value (null for none)."""
    return df.withColumn("least_p", F.array_min(F.transform(pvalues, lambda v: v["p"])))


def explode_buckets(df: DataFrame, buckets: str = "buckets", name: str = "category") -> DataFrame:
    """A row for each category of an article; articles without one are left out."""
    return df.withColumn(name, F.explode(buckets))


def trend(df: DataFrame, least: str = "least_p", by: tuple[str, ...] = ("category", "year")) -> DataFrame:
    """Articles in all, with any p-value, and with one at or below each threshold; an article counts once for each."""
    c = F.col(least)
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    return df.groupBy(*by).agg(F.count("*").alias("total"), count(c.isNotNull()).alias("any_p"), *[count(c <= F.lit(t)).alias(n) for n, t in THRESHOLDS.items()])


def dense_grid(counts: DataFrame, categories: list[str] | None = None, years: tuple[int, int] = TREND_YEARS) -> DataFrame:
    """A row for every category and year, zeros where ``counts`` has none. The grid is of fixed size."""
    spark = counts.sparkSession
    names = categories or [c.bucket for c in CATEGORIES]
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("category")).select("category", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))).alias("year"))
    values = [c for c in counts.columns if c not in ("category", "year")]
    return grid.join(counts, ["category", "year"], "left").select("category", "year", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in values])


def proportion(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, null for an empty whole."""
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, digits))
