"""Article metadata: union of file lists, citations, fixes, flags, publication-type enrichment."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigscan.functions import citation
from sigscan.functions.categories import null_id, type_flags
from sigscan.functions.text import trim_ws
from sigscan.session import exists, materialize, shared_path


def union_filelists(frames: list[DataFrame], distinct: bool = False) -> DataFrame:
    """UNION ALL by column name, nulls for columns that a list lacks; ``distinct`` drops equal rows."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.distinct() if distinct else out


def ensure_column(df: DataFrame, name: str, value: str = "") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def parse_citations(df: DataFrame, column: str = "Article Citation") -> DataFrame:
    """Add journal and year (text)."""
    c = F.col(f"`{column}`")
    return df.withColumn("journal", citation.journal(c)).withColumn("year", citation.year(c))


def split_citations(df: DataFrame, column: str = "Article Citation") -> tuple[DataFrame, DataFrame]:
    """Rows whose citation fits the grammar, and the others for review."""
    ok = citation.is_valid(F.col(f"`{column}`"))
    return df.where(ok), df.where(~ok)


def apply_fixes(df: DataFrame, fixes: DataFrame, key: str = "AccessionID") -> DataFrame:
    """Cells of ``fixes`` that are not null override those of the row with the same key; of several fixes the greatest row wins."""
    shared = [c for c in fixes.columns if c != key and c in df.columns]
    one = fixes.groupBy(key).agg(F.max(F.struct(*shared)).alias("__fix"))
    return df.join(one, key, "left").select(*[F.coalesce(F.col("__fix")[c], F.col(f"`{c}`")).alias(c) if c in shared else F.col(f"`{c}`") for c in df.columns])


def add_type_flags(df: DataFrame, column: str = "PublicationType") -> DataFrame:
    return df.withColumns(type_flags(F.col(column)))


def add_journal_flag(df: DataFrame, journals: DataFrame, column: str = "journal", name: str = "clinical_useful_journal") -> DataFrame:
    """1 if the journal is in the list, compared trimmed and in lower case. The list is distinct, so rows never multiply."""
    known = journals.select(F.lower(trim_ws(F.col(journals.columns[0]))).alias("__j")).where("__j is not null").distinct()
    return df.withColumn("__k", F.lower(trim_ws(F.col(column)))).join(known, F.col("__k") == F.col("__j"), "left").withColumn(name, F.col("__j").isNotNull().cast("int")).drop("__k", "__j")


def refine(df: DataFrame) -> DataFrame:
    """Drop what routing does not need and rename the key."""
    return df.drop("journal", "PMID", "PublicationType").withColumnRenamed("AccessionID", "pmcid")


Fetcher = Callable[[DataFrame, int], DataFrame]


ASKED = "PMID string, batch int, fetched string"


def enrich_types(df: DataFrame, fetch: Fetcher, batches: tuple[int, ...] = (200, 20, 1), dup_policy: str = "all", order: str | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Fill blank PublicationType cells by PMID in passes of smaller and smaller requests; returns rows and unresolved ids.

    ``fetch(ids, batch)`` takes distinct ids (PMID) and returns (PMID, fetched)
    for those that came back. Each pass asks only for what the former ones did not
    return with a value, and what it asked and got is written to ``folder`` (a
    fresh shared one by default) as soon as it ends: an id is asked once a pass,
    whatever reads the results, and a run that is given the folder of one that was
    broken off asks only for what that one had not. ``dup_policy="last"`` fills only the last row (by ``order``) of a PMID.
    """
    spark = df.sparkSession
    df = ensure_column(df, "PublicationType").withColumn("PMID", null_id(F.col("PMID")))
    blank = F.coalesce(trim_ws(F.col("PublicationType")) == "", F.lit(True)) & F.col("PMID").isNotNull()
    wanted, folder = materialize(df.where(blank).select("PMID").distinct(), "wanted"), folder or shared_path(spark, "asked")

    def asked() -> DataFrame:
        return spark.read.schema(ASKED).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], ASKED)

    def answered() -> DataFrame:
        return asked().where("trim(fetched) <> ''").groupBy("PMID").agg(F.max("fetched").alias("fetched"))

    for n in batches:
        # one write takes each pass: what is to be asked, asked once, and what came back
        before = asked().where((F.col("batch") == n) | (F.trim("fetched") != "")).select("PMID")
        todo = wanted.join(before, "PMID", "left_anti")
        got = fetch(todo, n).select("PMID", "fetched").groupBy("PMID").agg(F.max("fetched").alias("fetched"))
        todo.join(got, "PMID", "left").select("PMID", F.lit(n).alias("batch"), "fetched").write.mode("append").parquet(folder)
    found = answered()
    left = wanted.join(found, "PMID", "left_anti")
    fill = blank
    if dup_policy == "last":
        if order is None:
            raise ValueError("the last row of a PMID needs an order")
        last = Window.partitionBy("PMID", blank).orderBy(F.col(order).desc())
        df = df.withColumn("__last", F.row_number().over(last) == 1)
        fill = blank & F.col("__last")
    out = df.join(found, "PMID", "left").withColumn("PublicationType", F.when(fill, F.coalesce("fetched", "PublicationType")).otherwise(F.col("PublicationType")))
    return out.drop("fetched", "__last"), left
