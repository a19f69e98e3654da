"""Distributions of single p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscan.functions.bins import bin_index, bin_label, histogram_bin, normalize_operator


def explode_pvalues(df: DataFrame, pvalues: str = "pv") -> DataFrame:
    """A row for each p-value. An outer explode and a filter on its element keep the extraction in the plan once."""
    return df.withColumn("__v", F.explode_outer(pvalues)).where("__v is not null").withColumn("p", F.col("__v.p")).withColumn("op", F.col("__v.op")).drop("__v", pvalues)


def bin_counts(values: DataFrame, by: tuple[str, ...] = ("category",)) -> DataFrame:
    """(by, bin): p-values by operator and in all."""
    o = normalize_operator(F.col("op"))
    n = lambda v: F.sum((o == v).cast("long"))
    counted = values.groupBy(*by, bin_index(F.col("p")).alias("__bin")).agg(n("<").alias("lt"), n("=").alias("eq"), n(">").alias("gt"), n("other").alias("other"), F.count("*").alias("total"))
    return counted.select(*by, bin_label(F.col("__bin")).alias("bin"), "lt", "eq", "gt", "other", "total")


def sorted_bins(counts: DataFrame, by: tuple[str, ...] = ("category",)) -> DataFrame:
    """Bins in the order of their keys; labels are of one width, so their order as text is that of their values."""
    return counts.orderBy(*by, "bin")


def totals(df: DataFrame, pvalues: str = "pv", by: tuple[str, ...] = ("category",)) -> DataFrame:
    """(by): articles and p-values."""
    return df.groupBy(*by).agg(F.count("*").alias("articles"), F.sum(F.size(pvalues).cast("long")).alias("pvalues"))


def histogram(values: DataFrame) -> DataFrame:
    """(bin 0..49, n): p-values in bins of a thousandth, edges a hair above the thousandths; values outside are left out."""
    return values.select(histogram_bin(F.col("p")).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
