"""Routing of articles to (category, year) buckets: labels, decisions, manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigscan.functions.categories import CATEGORIES, article_id, bucket_array, truthy, year_of
from sigscan.session import materialize

# fixed values: the headers that label tables have
ID_NAMES, YEAR_NAMES = ("pmc id", "pmc_id", "pmcid"), ("year", "pdat_year", "pub_year")
# fixed values: the reasons in skip logs, in the order in which they are decided
UNRECOGNIZED, DUPLICATE, MISSING, NO_FLAGS, UNREADABLE = "non-xml or unrecognized filename", "duplicate-pmcid", "metadata-missing", "no-category-flags", "extract-failed"
ACCEPT = "accept"


def _pick(names: dict[str, str], wanted: tuple[str, ...], what: str) -> str:
    for w in wanted:
        if w in names:
            return names[w]
    raise ValueError(f"labels need a column for the {what}: one of {', '.join(wanted)}")


def load_labels(df: DataFrame, order: str | None = None) -> DataFrame:
    """(pmcid, year, buckets) of a label table with any of the known headers; the last row (by ``order``) of an id wins.

    Rows of a table have no order of their own, so without one the greatest (year, buckets) wins: reruns agree.
    """
    names = {c.strip().lower(): c for c in reversed(df.columns)}
    key, year = _pick(names, ID_NAMES, "article id"), _pick(names, YEAR_NAMES, "year")
    buckets = bucket_array({c.flag: truthy(F.col(f"`{names[c.flag]}`")) for c in CATEGORIES if c.flag in names})
    rows = df.select(article_id(F.col(f"`{key}`")).alias("pmcid"), year_of(F.col(f"`{year}`")).alias("year"), buckets.alias("buckets"), (F.col(order) if order else F.lit(0)).alias("__at"))
    last = rows.where("pmcid is not null").groupBy("pmcid").agg(F.max(F.struct("__at", "year", "buckets")).alias("v"))
    return last.select("pmcid", F.col("v.year").alias("year"), F.col("v.buckets").alias("buckets"))


def member_id(path: Column) -> Column:
    """Upper-case id of a member named ``PMC<digits>.xml``, null for any other name."""
    found = F.upper(F.regexp_extract(path, r"(?i)(?:^|/)(PMC[0-9]+)\.xml$", 1))
    return F.when(found != "", found)


def decide(members: DataFrame, labels: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Add pmcid, year, buckets and reason to members (src_tar, inner_path, member_pos[, readable]).

    The first copy of an id by (src_tar, member_pos, inner_path) is judged, later
    ones, rows that repeat the first and ids in ``seen`` (pmcid) are duplicates,
    whether or not the id has labels. Members are read once and written with a
    number for each row, which tells equal rows apart.
    """
    df = members if "readable" in members.columns else members.withColumn("readable", F.lit(True))
    rows = materialize(df.withColumn("pmcid", member_id(F.col("inner_path"))).withColumn("__row", F.monotonically_increasing_id()), "members")
    named, at = rows.where("pmcid is not null"), F.struct("src_tar", "member_pos", "inner_path", "__row")
    # the first copy of an id comes from a minimum that copies of a hot id combine into before they are shuffled
    first = named.groupBy("pmcid").agg(F.min(at).alias("__first"))
    named = named.join(first, "pmcid").withColumn("__again", F.col("__first.__row") != F.col("__row")).drop("__first")
    if seen is not None:
        known = seen.where("pmcid is not null and pmcid <> ''").select(F.col("pmcid").alias("__seen")).distinct()
        named = named.join(known, F.col("pmcid") == F.col("__seen"), "left").withColumn("__again", F.col("__again") | F.col("__seen").isNotNull()).drop("__seen")
    others = rows.where("pmcid is null").withColumn("__again", F.lit(False))
    return reasons(named.unionByName(others).drop("__row"), labels, "__again")


def reasons(rows: DataFrame, labels: DataFrame, again: str) -> DataFrame:
    """Add year, buckets and reason to members (pmcid, readable) of which ``again``, which goes, says whether their id came before."""
    unnamed = rows.where("pmcid is null")  # apart, as they would all meet in one task of the join
    named = rows.where("pmcid is not null").join(labels.withColumn("__known", F.lit(True)), "pmcid", "left")
    df = named.unionByName(unnamed, allowMissingColumns=True)
    reason = (
        F.when(F.col("pmcid").isNull(), UNRECOGNIZED).when(F.col(again), DUPLICATE).when(F.col("__known").isNull(), MISSING)
        .when(F.size("buckets") == 0, NO_FLAGS).when(~F.col("readable"), UNREADABLE).otherwise(ACCEPT)
    )
    return df.withColumn("reason", reason).drop(again, "__known")


def target_path(bucket: Column, year: Column) -> Column:
    return F.concat_ws("/", F.lit("pmc"), bucket, F.concat(F.coalesce(year.cast("string"), F.lit("unknown-year")), F.lit(".tar")))


def copies(decided: DataFrame) -> DataFrame:
    """A row for each bucket of an accepted article."""
    return decided.where(F.col("reason") == ACCEPT).withColumn("bucket", F.explode("buckets"))


def manifest(decided: DataFrame) -> DataFrame:
    """(pmcid, year, categories, src_tar, output_tar_paths) of accepted articles, lists sorted."""
    b = F.array_sort("buckets")
    paths = F.transform(b, lambda x: target_path(x, F.col("year")))
    kept = decided.where(F.col("reason") == ACCEPT).withColumn("__paths", F.array_join(paths, ";"))
    return kept.select("pmcid", F.coalesce(F.col("year").cast("string"), F.lit("unknown")).alias("year"), F.array_join(b, ";").alias("categories"), "src_tar", F.col("__paths").alias("output_tar_paths"))


def skipped(decided: DataFrame) -> DataFrame:
    """(pmcid, src_tar, inner_path, reason) of all others."""
    return decided.where(F.col("reason") != ACCEPT).select(F.coalesce("pmcid", F.lit("")).alias("pmcid"), "src_tar", "inner_path", "reason")


def crosstab(decided: DataFrame) -> DataFrame:
    """(bucket, year, n) of copies."""
    return copies(decided).groupBy("bucket", F.coalesce(F.col("year").cast("string"), F.lit("unknown")).alias("year")).agg(F.count("*").alias("n"))


def sorted_crosstab(decided: DataFrame) -> DataFrame:
    """The cross-table in the order of bucket and of the year's text."""
    return crosstab(decided).orderBy("bucket", "year")


# fixed values: the collections of the open-access subset in the order in which their archives are routed: of copies in several, the first one's is taken.
COLLECTIONS = ("comm", "noncomm", "other")


def union_collections(**members: DataFrame) -> DataFrame:
    """Members (src_tar, ...) of the collections as one table; src_tar gets the collection's place in front, so that :func:`decide` takes copies in that order."""
    wrong = sorted(set(members) - set(COLLECTIONS))
    if wrong or not members:
        raise ValueError(f"collections are {', '.join(COLLECTIONS)}" + f", not {', '.join(wrong)}" * bool(wrong))
    placed = [members[c].withColumn("src_tar", F.concat(F.lit(f"{k}_{c}/"), F.col("src_tar"))) for k, c in enumerate(COLLECTIONS) if c in members]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed)


def write_buckets(copied: DataFrame, path: str) -> None:
    """Append copies as Parquet partitioned by bucket and year; rows are dealt by both and salted, so that a hot bucket has many writers."""
    n = copied.sparkSession.sparkContext.defaultParallelism
    dealt = copied.withColumn("year", F.coalesce(F.col("year").cast("string"), F.lit("unknown-year"))).withColumn("__salt", F.pmod(F.xxhash64("pmcid"), F.lit(n)))
    dealt.repartition("bucket", "year", "__salt").drop("__salt").write.mode("append").partitionBy("bucket", "year").parquet(path)
