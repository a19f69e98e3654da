"""Completeness checks: missing ids, count reconciliation, repeated lines, chunks, tables of ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigscan.functions.text import not_blank
from sigscan.operators.ordering import positions
from sigscan.session import materialize, partitions_for


def missing_ids(wanted: DataFrame, present: DataFrame, key: str = "article_id") -> DataFrame:
    """Distinct ids of ``wanted`` that ``present`` lacks, in string order."""
    return wanted.select(F.col(key).cast("string").alias(key)).distinct().join(present.select(F.col(key).cast("string").alias(key)), key, "left_anti").orderBy(key)


def reconcile(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("category", "year")) -> DataFrame:
    """Counts of both sides by key with a status: ok, or mismatch."""
    a, b = (d.groupBy(*by).agg(F.count("*").alias(n)) for d, n in ((left, "n_left"), (right, "n_right")))
    both = a.join(b, list(by), "full_outer").select(*by, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_left", "n_right")])
    return both.withColumn("status", F.when(F.col("n_left") == F.col("n_right"), "ok").otherwise("mismatch"))


def distinct_lines(lines: DataFrame, text: str = "line", at: str = "pos", by: tuple[str, ...] = ()) -> DataFrame:
    """The first of equal lines, by position. Aggregation rather than a window: copies combine before the shuffle."""
    return lines.groupBy(*by, text).agg(F.min(at).alias(at))


def write_distinct_lines(lines: DataFrame, order: list[str], text: str, folder: str) -> None:
    """Write the first of equal lines, by ``order``, to text files in ``folder`` whose names sort in that order.

    Copies combine before they are shuffled; what is left is dealt by ranges of
    its order, so a task writes the lines between two bounds. Line feeds inside a line are not kept apart.
    """
    at = F.struct(*order)
    first = lines.groupBy(text).agg(F.min(at).alias("__at"))
    n = partitions_for(lines, 64 << 20)
    first.repartitionByRange(n, "__at").sortWithinPartitions("__at").select(F.coalesce(text, F.lit("")).alias("value")).write.mode("overwrite").text(folder)


def read_ordered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(pos, line) of the files of a folder in the order of their names: the place of each line in all of them."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    lines = spark.read.option("lineSep", "\n").text(folder).select(name.alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"), F.col("value").alias("line"))
    return positions(lines, [], ["__file", "__block", "__line"]).select("pos", "line")


def without_blank_lines(files: DataFrame) -> DataFrame:
    """(path, text) of text files with their blank lines dropped and the others' ends stripped of line marks; a file of blank lines becomes empty."""
    lines = F.filter(F.split("text", r"\r\n|\r|\n"), not_blank)
    return files.withColumn("text", F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""))


def append_missing(corpus: DataFrame, fetched: DataFrame, key: str = "article_id") -> DataFrame:
    """The corpus with fetched rows whose ids it lacks."""
    return corpus.unionByName(fetched.join(corpus.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def chunks(df: DataFrame, order: str, size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``chunk``: fixed-size request batches in order, numbered from 0.

    Without ``by`` the numbers come from counts of range partitions, not from one task. The ordered rows are
    written first: both uses of them must see the same partitions, which adaptive execution does not promise.
    """
    if by:
        return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / size).cast("long"))
    indexed = materialize(df.orderBy(order).withColumn("__id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("__id", 33)
    base = indexed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    base = base.withColumn("__base", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    out = indexed.withColumn("__part", part).join(F.broadcast(base), "__part")  # one row a partition
    return out.withColumn("chunk", F.floor((F.col("__base") + F.col("__id").bitwiseAND((1 << 33) - 1)) / size).cast("long")).drop("__id", "__part", "__base")


def extent(df: DataFrame, column: str) -> DataFrame:
    """(n, least, greatest) of a column."""
    return df.agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("greatest"))
