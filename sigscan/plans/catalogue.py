"""The query catalogue of the literature pipeline, and DuckDB SQL for each query that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigscan.functions import citation
from sigscan.functions.categories import CATEGORIES, DISTRIBUTION_YEARS, TREND_YEARS, bucket_array, null_id, predicate, publication_types, type_flags
from sigscan.functions.pvalues import PATTERN, extract_pvalues
from sigscan.functions.text import WS, clean_text, file_stem, first_token, homogenize_number, line_count
from sigscan.operators import distribution, integrity, metadata, ordering, routing, trend
from sigscan.plans import carriers
from sigscan.plans.carriers import ARTICLES, CORE_JOURNALS, FILELIST, LABELS, MEMBERS, REPEATED, derive
from sigscan.session import shared_path, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---- SQL pieces ----


def re2(pattern: str) -> str:
    """A pattern in the spelling of RE2, as a SQL string; RE2 needs no possessive repetitions."""
    pattern = pattern.replace("*+", "*").replace("++", "+")
    out = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", re.sub(r"\\x([0-9a-f]{2})(?![0-9a-f}])", r"\\x{\1}", pattern))
    return "'" + out.replace("'", "''") + "'"


_WS = re2(f"[{WS}]+")
_TRIM = lambda x: f"regexp_replace(regexp_replace({x}, {re2(f'^[{WS}]+')}, ''), {re2(f'[{WS}]+$')}, '')"
_HOMOGENIZE = lambda x: f"regexp_replace(translate({x}, ',•x×E()', '..eee'), {_WS}, '', 'g')"
_GROUPS = "['op', 'digits', 'percent', 'times', 'base', 'mark', 'exponent']"
_TYPES_OF = lambda x: f"list_filter(list_transform(string_split(coalesce({x}, ''), ' ; '), lambda t: lower({_TRIM('t')})), lambda t: t <> '')"
_HAS = lambda t, v: f"list_contains({t}, '{v}')"

PVALUES = f"""
    arts AS ({ARTICLES}),
    hits AS (SELECT doc_id, publication_type, journal, year, unnest(regexp_extract_all(line, {re2(PATTERN)})) AS m, generate_subscripts(regexp_extract_all(line, {re2(PATTERN)}), 1) AS k FROM arts),
    parts AS (SELECT *, regexp_extract(m, {re2(PATTERN)}, {_GROUPS}) AS g FROM hits),
    nums AS (SELECT *, {_HOMOGENIZE("g.digits")} AS d, TRY_CAST(nullif(coalesce(g.base, ''), '') AS DOUBLE) AS b, coalesce(nullif({_HOMOGENIZE("coalesce(g.exponent, '')")}, ''), '1') AS e FROM parts),
    vals AS (
        SELECT doc_id, publication_type, journal, year, k,
               CASE WHEN len(d) - len(replace(d, '.', '')) > 1 THEN NULL
                    WHEN g.percent = '%' THEN CAST(d AS DOUBLE) * CAST(0.01 AS DOUBLE)
                    WHEN coalesce(g.times, '') <> '' OR coalesce(g.mark, '') <> '' THEN
                         CAST(d AS DOUBLE) * CASE WHEN coalesce(b, 0) IN (0, 10) THEN TRY_CAST('1e' || e AS DOUBLE) ELSE pow(b, CAST(e AS DOUBLE)) END
                    ELSE CAST(d AS DOUBLE) END AS p,
               CASE WHEN regexp_matches(g.op, '[<≤]|less') AND regexp_matches(g.op, '[>≥]') THEN 'ambiguous' WHEN regexp_matches(g.op, '[<≤]|less') THEN '<'
                    WHEN regexp_matches(g.op, '[>≥]') THEN '>' ELSE '=' END AS op
        FROM nums),
    pv AS (SELECT doc_id, publication_type, journal, year, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS pos, p, op FROM vals WHERE p > 0 AND p < 1)"""

_CORE = ", ".join("'" + j.strip().lower() + "'" for j in CORE_JOURNALS)


def _buckets_sql(types: str = "types", journal: str = "journal") -> str:
    conds = {"all": "true", "cuj": f"lower({_TRIM(journal)}) IN ({_CORE})"}
    for c in CATEGORIES:
        if c.has:
            conds[c.key] = _HAS(types, c.has) + (f" AND NOT {_HAS(types, c.without)}" if c.without else "")
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {conds[c.key]} THEN '{c.bucket}' END" for c in CATEGORIES) + "], lambda x: x IS NOT NULL))"


BUCKETED = PVALUES + f""",
    least_p AS (SELECT doc_id, min(p) AS least_p, count(*) AS n FROM pv GROUP BY doc_id),
    typed AS (SELECT doc_id, year, {_TYPES_OF("publication_type")} AS types, journal FROM arts),
    placed AS (SELECT doc_id, year, unnest({_buckets_sql()}) AS category FROM typed)"""
_TREND = "count(*) AS total, count(least_p) AS any_p, " + ", ".join(f"CAST(count(*) FILTER (WHERE least_p <= CAST({t} AS DOUBLE)) AS BIGINT) AS {n}" for n, t in trend.THRESHOLDS.items())
_GRID = ", ".join(f"('{c.bucket}')" for c in CATEGORIES)


# ---- inputs ----


def journals(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, CORE_JOURNALS))).alias("MedlineTA"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with their buckets and, extracted once for each article before any fan-out, their p-values."""
    df = spread(derive(spark, sf_dir, ARTICLES))
    df = metadata.add_journal_flag(df, journals(spark))
    flags = {k: v == 1 for k, v in type_flags(F.col("publication_type")).items()} | {"clinical_useful_journal": F.col("clinical_useful_journal") == 1}
    return df.select("doc_id", "line", "year", bucket_array(flags).alias("buckets"))


def with_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).withColumn("pv", extract_pvalues(F.col("line"))).drop("line")


# ---- p-values ----


@query(f"WITH {PVALUES} SELECT doc_id, pos, p, op FROM pv")
def pvalue_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(derive(spark, sf_dir, ARTICLES)).select("doc_id", extract_pvalues(F.col("line")).alias("pv"))
    return df.select("doc_id", F.posexplode_outer("pv").alias("pos", "v")).where("v is not null").select("doc_id", "pos", "v.p", "v.op")


@query(f"WITH {BUCKETED} SELECT category, year, {_TREND} FROM placed LEFT JOIN least_p USING (doc_id) GROUP BY category, year")
def trend_by_category_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trend.with_least(with_pvalues(spark, sf_dir)).select("year", "buckets", "least_p")
    return trend.trend(trend.explode_buckets(df))


@query(
    f"WITH {BUCKETED}, t AS (SELECT category, year, {_TREND} FROM placed LEFT JOIN least_p USING (doc_id) GROUP BY category, year), "
    f"grid AS (SELECT c.category, CAST(y.year AS INTEGER) AS year FROM (VALUES {_GRID}) c(category), range({TREND_YEARS[0]}, {TREND_YEARS[1] + 1}) y(year)) "
    + "SELECT category, year, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("total", "any_p", *trend.THRESHOLDS)) + " FROM grid LEFT JOIN t USING (category, year)"
)
def trend_dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.dense_grid(trend_by_category_year(spark, sf_dir))


@query(f"WITH {BUCKETED}, t AS (SELECT category, year, {_TREND} FROM placed LEFT JOIN least_p USING (doc_id) GROUP BY category, year) SELECT category, year, CAST(round(CAST(100.0 AS DOUBLE) * any_p / total, 2) AS DOUBLE) AS percent FROM t")
def trend_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend_by_category_year(spark, sf_dir).select("category", "year", trend.proportion(F.col("any_p"), F.col("total")).alias("percent"))


_LATE = f"year BETWEEN {DISTRIBUTION_YEARS[0]} AND {DISTRIBUTION_YEARS[1]}"
_BIN = "CASE WHEN p <= CAST(0.05 AS DOUBLE) THEN least(50, greatest(1, CAST(ceil(p / CAST(0.001 AS DOUBLE)) AS INTEGER))) ELSE 51 END"
_OPS = ", ".join(f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS {n}" for n, c in (("lt", "op = '<'"), ("eq", "op = '='"), ("gt", "op = '>'"), ("other", "op NOT IN ('<', '=', '>')")))


@query(f"WITH {BUCKETED} SELECT category, '0.' || lpad(CAST({_BIN} AS VARCHAR), 3, '0') AS bin, {_OPS}, count(*) AS total FROM placed JOIN pv USING (doc_id) WHERE placed.{_LATE} GROUP BY 1, 2")
def pvalue_bins_by_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_pvalues(spark, sf_dir).where(_LATE)
    # binned once for each article, then fanned out to its categories
    counts = distribution.bin_counts(distribution.explode_pvalues(df), ("buckets",))
    out = counts.withColumn("category", F.explode("buckets")).groupBy("category", "bin")
    return out.agg(*[F.sum(c).alias(c) for c in ("lt", "eq", "gt", "other", "total")])


@query(ORACLES["pvalue_bins_by_operator"])
def pvalue_bins_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.sorted_bins(pvalue_bins_by_operator(spark, sf_dir))


@query(f"WITH {BUCKETED} SELECT category, count(*) AS articles, CAST(sum(coalesce(n, 0)) AS BIGINT) AS pvalues FROM placed LEFT JOIN least_p USING (doc_id) WHERE {_LATE} GROUP BY category")
def pvalue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.totals(trend.explode_buckets(with_pvalues(spark, sf_dir).where(_LATE)))


_EDGE = "({} * CAST(0.001 AS DOUBLE) + CAST(0.000000000001 AS DOUBLE))"


@query(
    f"WITH {PVALUES}, edges AS (SELECT CAST(k AS INTEGER) AS bin, {_EDGE.format('k')} AS low, {_EDGE.format('(k + 1)')} AS high FROM range(50) t(k)) "
    "SELECT bin, count(*) AS n FROM pv JOIN edges ON p >= low AND (p < high OR (bin = 49 AND p = high)) GROUP BY bin"
)
def pvalue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(derive(spark, sf_dir, ARTICLES)).select("doc_id", extract_pvalues(F.col("line")).alias("pv"))
    return distribution.histogram(distribution.explode_pvalues(df))


# ---- metadata ----

_LIST = f"f AS ({FILELIST})"
_CITE = f"c AS (SELECT doc_id, citation, coalesce(regexp_matches({_TRIM('citation')}, {re2(citation.PATTERN)}), false) AS ok, regexp_extract({_TRIM('citation')}, {re2(citation.PATTERN)}, ['journal', 'year']) AS g FROM f)"
_J, _Y = f"CASE WHEN ok THEN nullif({_TRIM('g.journal')}, '') END", "CASE WHEN ok THEN nullif(g.year, '') END"


@query(f"WITH {_LIST}, {_CITE} SELECT doc_id, {_J} AS journal, {_Y} AS year FROM c")
def citation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.parse_citations(derive(spark, sf_dir, FILELIST), "citation").select("doc_id", "journal", "year")


@query(f"WITH {_LIST}, {_CITE} SELECT doc_id, citation FROM c WHERE NOT ok")
def citation_invalid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.split_citations(derive(spark, sf_dir, FILELIST), "citation")[1].select("doc_id", "citation")


@query(
    f"WITH {_LIST}, {_CITE}, p AS (SELECT doc_id, {_J} AS journal, {_Y} AS year FROM c) SELECT doc_id, CASE WHEN doc_id % 9 = 2 THEN 'Fixed J' ELSE journal END AS journal, "
    "CASE WHEN doc_id % 18 = 2 THEN '1999' ELSE year END AS year FROM p"
)
def citation_fix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = metadata.parse_citations(derive(spark, sf_dir, FILELIST), "citation").select("doc_id", "journal", "year")
    fixes = table(spark, sf_dir, "documents").where("doc_id % 9 = 2").select("doc_id", F.lit("Fixed J").alias("journal"), F.expr("CASE WHEN doc_id % 18 = 2 THEN '1999' END").alias("year"))
    return metadata.apply_fixes(parsed, fixes, "doc_id")


_FLAGS = ", ".join(f"CAST({_HAS('types', c.has)}{f' AND NOT {_HAS(chr(116) + chr(121) + chr(112) + chr(101) + chr(115), c.without)}' if c.without else ''} AS INTEGER) AS {c.flag}" for c in CATEGORIES if c.has)
_FLAG_NAMES = [c.flag for c in CATEGORIES if c.has]


@query(f"WITH t AS (SELECT doc_id, {_TYPES_OF('publication_type')} AS types FROM ({ARTICLES})) SELECT doc_id, {_FLAGS}, 1 AS all_article FROM t")
def pubtype_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.add_type_flags(derive(spark, sf_dir, ARTICLES), "publication_type").select("doc_id", *_FLAG_NAMES, "all_article")


@query(f"SELECT doc_id, CAST(coalesce(lower({_TRIM('journal')}) IN ({_CORE}), false) AS INTEGER) AS clinical_useful_journal FROM ({ARTICLES})")
def journal_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.add_journal_flag(derive(spark, sf_dir, ARTICLES), journals(spark)).select("doc_id", "clinical_useful_journal")


@query(f"SELECT count(*) AS n, CAST(sum(CAST(coalesce(lower({_TRIM('journal')}) IN ({_CORE}), false) AS INTEGER)) AS BIGINT) AS matched FROM ({ARTICLES})")
def journal_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal_flag(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("clinical_useful_journal").alias("matched"))


_FIELDS = ["all", "rct", "ct", "meta", "review", "cuj", "Systematic_Review", "Observational_Study"]
_WITHIN = "year = 2000 AND doc_id % 3 <> 1 AND doc_id % 13 <> 5"
_FIELD_SQL = {c.key: ("true" if c.key == "all" else f"coalesce(lower({_TRIM('journal')}) IN ({_CORE}), false)" if c.key == "cuj" else _HAS("types", c.has) + (f" AND NOT {_HAS('types', c.without)}" if c.without else "")) for c in CATEGORIES} | {"Systematic_Review": _HAS("types", "systematic review"), "Observational_Study": _HAS("types", "observational study")}


@query(f"WITH t AS (SELECT doc_id, year, journal, {_TYPES_OF('publication_type')} AS types FROM ({ARTICLES})) SELECT doc_id, " + ", ".join(f"({_FIELD_SQL[f]}) AND {_WITHIN} AS is_{f.lower()}" for f in _FIELDS) + " FROM t")
def category_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = metadata.add_journal_flag(derive(spark, sf_dir, ARTICLES), journals(spark)).withColumn("types", publication_types(F.col("publication_type")))
    args = (F.col("types"), F.col("year"), F.expr("doc_id % 3 <> 1"), F.expr("doc_id % 13 <> 5"), F.col("clinical_useful_journal") == 1)
    return df.select("doc_id", *[predicate(f, 2000, *args).alias(f"is_{f.lower()}") for f in _FIELDS])


@query(f"WITH {_LIST}, {_CITE}, t AS (SELECT *, {_TYPES_OF('publication_type')} AS types FROM f) SELECT accession AS pmcid, {_Y} AS year, {_FLAGS}, 1 AS all_article FROM t JOIN c USING (doc_id)")
def refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derive(spark, sf_dir, FILELIST).select(F.col("accession").alias("AccessionID"), F.col("pmid").alias("PMID"), "citation", F.col("publication_type").alias("PublicationType"))
    return metadata.refine(metadata.add_type_flags(metadata.parse_citations(df, "citation"))).select("pmcid", "year", *_FLAG_NAMES, "all_article")


_PMID = f"CASE WHEN {_TRIM('pmid')} NOT IN ('', '0', 'nan', 'None') THEN {_TRIM('pmid')} END"


@query(f"WITH {_LIST} SELECT doc_id, {_PMID} AS pmid FROM f")
def pmid_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, FILELIST).select("doc_id", null_id(F.col("pmid")).alias("pmid"))


def _fetch(spark: SparkSession, sf_dir: str):
    """A service in a table: larger requests lose more ids, single ones all but a few."""

    def fetch(ids: DataFrame, n: int) -> DataFrame:
        lost = {200: "CAST(PMID AS INT) % 3 = 0", 20: "CAST(PMID AS INT) % 6 = 0", 1: "CAST(PMID AS INT) % 30 = 0"}[n]
        return ids.where(f"NOT ({lost})").select("PMID", F.concat(F.lit("Fetched Type "), (F.col("PMID").cast("int") % 4).cast("string")).alias("fetched"))

    return fetch


@query(
    f"WITH {_LIST}, n AS (SELECT doc_id, {_PMID} AS pmid, publication_type AS pt FROM f) SELECT doc_id, pmid, CASE WHEN pmid IS NOT NULL AND trim(coalesce(pt, '')) = '' AND CAST(pmid AS INT) % 30 <> 0 "
    "THEN 'Fetched Type ' || CAST(CAST(pmid AS INT) % 4 AS VARCHAR) ELSE pt END AS publication_type FROM n"
)
def enrich_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derive(spark, sf_dir, FILELIST).select("doc_id", F.col("pmid").alias("PMID"), F.col("publication_type").alias("PublicationType"))
    return metadata.enrich_types(df, _fetch(spark, sf_dir))[0].select("doc_id", F.col("PMID").alias("pmid"), F.col("PublicationType").alias("publication_type"))


@query(f"WITH {_LIST}, n AS (SELECT {_PMID} AS pmid, publication_type AS pt FROM f) SELECT DISTINCT pmid FROM n WHERE pmid IS NOT NULL AND trim(coalesce(pt, '')) = '' AND CAST(pmid AS INT) % 30 = 0")
def enrich_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derive(spark, sf_dir, FILELIST).select("doc_id", F.col("pmid").alias("PMID"), F.col("publication_type").alias("PublicationType"))
    return metadata.enrich_types(df, _fetch(spark, sf_dir))[1].select(F.col("PMID").alias("pmid"))


_BLANK = "pmid IS NOT NULL AND trim(coalesce(pt, '')) = ''"


@query(
    f"WITH {_LIST}, n AS (SELECT doc_id, {_PMID} AS pmid, publication_type AS pt FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY pmid, {_BLANK} ORDER BY doc_id DESC) AS k FROM n) "
    f"SELECT doc_id, pmid, CASE WHEN {_BLANK} AND k = 1 AND CAST(pmid AS INT) % 30 <> 0 THEN 'Fetched Type ' || CAST(CAST(pmid AS INT) % 4 AS VARCHAR) ELSE pt END AS publication_type FROM r"
)
def enrich_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows of a PMID only the last one is filled."""
    df = derive(spark, sf_dir, FILELIST).select("doc_id", F.col("pmid").alias("PMID"), F.col("publication_type").alias("PublicationType"))
    out = metadata.enrich_types(df, _fetch(spark, sf_dir), dup_policy="last", order="doc_id")[0]
    return out.select("doc_id", F.col("PMID").alias("pmid"), F.col("PublicationType").alias("publication_type"))


@query(f"WITH {_LIST}, n AS (SELECT doc_id, {_PMID} AS pmid FROM f) SELECT doc_id, pmid, CASE WHEN pmid IS NOT NULL AND CAST(pmid AS INT) % 30 <> 0 THEN 'Fetched Type ' || CAST(CAST(pmid AS INT) % 4 AS VARCHAR) ELSE '' END AS publication_type FROM n")
def enrich_without_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list that lacks the column gets it, blank, and has it filled."""
    df = derive(spark, sf_dir, FILELIST).select("doc_id", F.col("pmid").alias("PMID"))
    return metadata.enrich_types(df, _fetch(spark, sf_dir))[0].select("doc_id", F.col("PMID").alias("pmid"), F.col("PublicationType").alias("publication_type"))


@query(f"WITH {_LIST} SELECT accession, pmid, CAST(NULL AS VARCHAR) AS retracted FROM f WHERE doc_id % 2 = 0 UNION ALL SELECT accession, pmid, 'no' FROM f WHERE doc_id % 2 = 1 UNION ALL SELECT accession, pmid, CAST(NULL AS VARCHAR) FROM f WHERE doc_id % 2 = 0")
def filelist_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derive(spark, sf_dir, FILELIST)
    even, odd = f.where("doc_id % 2 = 0").select("accession", "pmid"), f.where("doc_id % 2 = 1").select("pmid", "accession", F.lit("no").alias("retracted"))
    return metadata.union_filelists([even, odd, even]).select("accession", "pmid", "retracted")


@query(f"WITH {_LIST} SELECT DISTINCT pmid, publication_type FROM f")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derive(spark, sf_dir, FILELIST).select("pmid", "publication_type")
    return metadata.union_filelists([f.where("pmid = ''"), f], distinct=True)


# ---- routing ----

_LABELS = f"""
    raw AS ({LABELS}),
    named AS (SELECT doc_id, upper({_TRIM("pmcid")}) AS k, split_part({_TRIM("year")}, '.', 1) AS y, * EXCLUDE (doc_id, pmcid, year) FROM raw),
    labels AS (SELECT CASE WHEN starts_with(k, 'PMC') THEN k ELSE 'PMC' || k END AS pmcid, TRY_CAST(y AS INTEGER) AS year,
               list_sort(list_filter([{", ".join(f"CASE WHEN lower({_TRIM(c.flag)}) IN ('1', 'true', 't', 'y', 'yes') THEN '{c.bucket}' END" for c in CATEGORIES)}], lambda x: x IS NOT NULL)) AS buckets FROM named)"""
_DECIDED = f"""{_LABELS},
    members AS (SELECT *, nullif(upper(regexp_extract(inner_path, '(?i)(^|/)(PMC[0-9]+)\\.xml$', 2)), '') AS pmcid FROM ({MEMBERS})),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY pmcid ORDER BY src_tar, member_pos) AS copy FROM members),
    decided AS (SELECT r.pmcid, year, buckets, src_tar, inner_path, member_pos, CASE WHEN r.pmcid IS NULL THEN 'non-xml or unrecognized filename' WHEN copy > 1 THEN 'duplicate-pmcid' WHEN l.pmcid IS NULL THEN 'metadata-missing'
        WHEN len(buckets) = 0 THEN 'no-category-flags' WHEN NOT readable THEN 'extract-failed' ELSE 'accept' END AS reason FROM ranked r LEFT JOIN labels l ON r.pmcid = l.pmcid)"""
_YEAR_TEXT = "coalesce(CAST(year AS VARCHAR), 'unknown')"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.load_labels(derive(spark, sf_dir, LABELS).withColumnRenamed("pmcid", " PMCID ").withColumnRenamed("year", "Year"), "doc_id")


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.decide(derive(spark, sf_dir, MEMBERS), labels(spark, sf_dir))


@query(f"WITH {_LABELS} SELECT pmcid, year, array_to_string(buckets, ';') AS buckets FROM labels")
def labels_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("pmcid", "year", F.array_join("buckets", ";").alias("buckets"))


@query(f"WITH {_DECIDED.replace(MEMBERS, REPEATED)} SELECT src_tar, inner_path, pmcid, reason FROM decided")
def route_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some members are listed twice: their first row is judged, the second is a duplicate."""
    return routing.decide(derive(spark, sf_dir, REPEATED), labels(spark, sf_dir)).select("src_tar", "inner_path", "pmcid", "reason")


@query(f"WITH {_DECIDED} SELECT coalesce(pmcid, '') AS pmcid, src_tar, inner_path, reason FROM decided WHERE reason <> 'accept'")
def route_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.skipped(decided(spark, sf_dir))


@query(
    f"WITH {_DECIDED} SELECT pmcid, {_YEAR_TEXT} AS year, array_to_string(buckets, ';') AS categories, src_tar, "
    "array_to_string(list_transform(buckets, lambda b: 'pmc/' || b || '/' || coalesce(CAST(year AS VARCHAR), 'unknown-year') || '.tar'), ';') AS output_tar_paths FROM decided WHERE reason = 'accept'"
)
def route_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.manifest(decided(spark, sf_dir))


@query(f"WITH {_DECIDED} SELECT bucket, {_YEAR_TEXT} AS year, count(*) AS n FROM (SELECT unnest(buckets) AS bucket, year FROM decided WHERE reason = 'accept') GROUP BY 1, 2")
def bucket_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.crosstab(decided(spark, sf_dir))


@query(ORACLES["bucket_crosstab"])
def bucket_crosstab_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.sorted_crosstab(decided(spark, sf_dir))


_COLLECTED = _DECIDED.replace("ranked AS (SELECT *,", "placed AS (SELECT * EXCLUDE (src_tar), concat(CASE left(src_tar, 1) WHEN 'a' THEN '2_other/' WHEN 'b' THEN '1_noncomm/' ELSE '0_comm/' END, src_tar) AS src_tar FROM members),\n    ranked AS (SELECT *,").replace("FROM members),\n    decided", "FROM placed),\n    decided")


@query(f"WITH {_COLLECTED} SELECT src_tar, inner_path, pmcid, reason FROM decided")
def collections_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three collections whose order is not that of their archives' names: of copies, the first collection's is taken."""
    members = derive(spark, sf_dir, MEMBERS)
    of = lambda letter: members.where(F.col("src_tar").startswith(letter))
    both = routing.union_collections(other=of("a"), noncomm=of("b"), comm=of("c"))
    return routing.decide(both, labels(spark, sf_dir)).select("src_tar", "inner_path", "pmcid", "reason")


@query(f"WITH {_LABELS} SELECT count(*) AS n, min(year) AS least, max(year) AS greatest FROM labels")
def label_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.extent(labels(spark, sf_dir), "year")


# ---- integrity ----


@query("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS article_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND doc_id IS NOT NULL")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda t: table(spark, sf_dir, t).select(F.col("doc_id").alias("article_id"))
    return integrity.missing_ids(ids("documents"), ids("labels"))


_A = "SELECT source AS category, CAST(doc_id % 5 AS INTEGER) AS year FROM documents"


@query(f"WITH a AS (SELECT category, year, count(*) AS n FROM ({_A}) GROUP BY ALL), b AS (SELECT category, year, count(*) AS n FROM ({_A} WHERE doc_id % 20 <> 3) GROUP BY ALL) SELECT category, year, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, CASE WHEN coalesce(a.n, 0) = coalesce(b.n, 0) THEN 'ok' ELSE 'mismatch' END AS status FROM a FULL JOIN b USING (category, year)")
def count_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category"), (F.col("doc_id") % 5).cast("int").alias("year"))
    return integrity.reconcile(docs, docs.where("doc_id % 20 <> 3"))


_LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents"


@query(f"SELECT line, CAST(min(doc_id * 1000000 + k) AS BIGINT) AS pos FROM ({_LINES}) GROUP BY line")
def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line"))
    return integrity.distinct_lines(lines.select("line", (F.col("doc_id") * 1000000 + F.col("k")).alias("pos"))).select("line", "pos")


@query("SELECT doc_id, lang, text, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 200 AS BIGINT) AS chunk FROM documents")
def id_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.chunks(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id", 200)


@query("SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0")
def refetch_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return integrity.append_missing(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 2 = 0 or doc_id % 3 = 0"), "doc_id")


# ---- text ----


@query(f"SELECT doc_id, {_TRIM('regexp_replace(coalesce(text, ' + chr(39) * 2 + '), ' + re2('[' + chr(92) + 'r' + chr(92) + 'n' + chr(92) + 't ]+') + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS text FROM documents")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


_NUMBERISH = f"concat('(', CAST(doc_id AS STRING), '{carriers.text(['x'])[0][1:-1]} 10E-', ',5 • exp×', coalesce(lang, ''), ')')"


@query(f"SELECT doc_id, {_HOMOGENIZE(_NUMBERISH)} AS number FROM documents")
def homogenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", homogenize_number(F.expr(_NUMBERISH)).alias("number"))


@query(
    f"SELECT doc_id, nullif(regexp_extract({_TRIM('line')}, {re2(f'^[^{WS}]+')}), '') AS id, CAST(len(list_filter(regexp_split_to_array(line, '\\r\\n|\\r|\\n'), lambda x: {_TRIM('x')} <> '')) AS INTEGER) AS n_lines, "
    f"'PMC' || CAST(doc_id AS VARCHAR) AS stem FROM ({ARTICLES})"
)
def line_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derive(spark, sf_dir, ARTICLES)
    path = F.concat(F.lit("a.b/c/PMC"), F.col("doc_id").cast("string"), F.lit(".xml"))
    return df.select("doc_id", first_token(F.col("line")).alias("id"), line_count(F.col("line")).alias("n_lines"), file_stem(path).alias("stem"))


@query("SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.ordered_concat(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", F.coalesce("text", F.lit(""))], "text")


_LINE_AT = f"SELECT line, doc_id, k, row_number() OVER (PARTITION BY line ORDER BY doc_id, k) AS copy FROM ({_LINES})"


@query(f"SELECT CAST(row_number() OVER (ORDER BY doc_id, k) - 1 AS BIGINT) AS pos, line FROM ({_LINE_AT}) WHERE copy = 1")
def lines_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal lines, written in the order of document and line as files whose names keep that order, and read back."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line"))
    folder = shared_path(spark, "distinct-lines")
    integrity.write_distinct_lines(lines, ["doc_id", "k"], "line", folder)
    return integrity.read_ordered_lines(spark, folder)
