"""Literature-shaped inputs derived from the driver's tables by SQL that Spark and DuckDB read alike.

The tables hold no p-values, citations or archives, so phrases are appended to
the whole text of each document, chosen by integer arithmetic on doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigscan.session import table

#: One phrase for every behaviour of the p-value grammar.
PHRASES = [
    " (p < 0.05)", " P-value=0.03", " p values ≤ .01 ", " p<.05, and", " p<.05.", " p<0.05,", " p<0.05.", " p=0,05", " p=0•05",
    " p=5%", " p = 0.1 %", " p=5e-4", " p=5 E -4", " p=5×10-4", " p=5 x 10(-4)", " p=0.04 × 10−4", " p=10-4", " p=10^-4",
    " p=0.05 23 patients", " p < 0.05 - 12", " p=1.0", " p=0", " p=0.000", " p less than 0.05", " p value of < 0.05", " p of 0.03",
    " p < = 0.05", " [p<0.05", " ;p<0.05", " P = NS", " p<0.05 p<0.01", " p<0.05; p<0.01", " (p<0.05)(p<0.01)", " p<>0.05",
    " p=0.05 xenografts", " p=0.01-0.05", " p=0.02E5", " p > 0.2", " p≥0.5", " p=3x2(-3)",
]
#: A made-up list of core journals, padded and in mixed case.
CORE_JOURNALS = ["Acta Test", " annals of tests ", "J Sample Res", "Ward Notes", "CLIN EXAMPLE"]


def case(by: str, values: list[str], otherwise: str = "NULL") -> str:
    return f"CASE {by} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + f" ELSE {otherwise} END"


def text(values: list[str]) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


_ID = "CAST(doc_id AS STRING)"
_SIGN = case("doc_id % 5", text(["<", "=", ">", "<=", "≥"]))
NUMERIC = f"concat(' (p ', {_SIGN}, ' 0.', lpad(CAST((doc_id * 7919) % 1000 AS STRING), 3, '0'), ')')"
LINE = f"concat('PMC', {_ID}, ' ', coalesce(text, ''), {NUMERIC}, {case(f'doc_id % {len(PHRASES)}', text(PHRASES))})"
TYPES = (
    "concat_ws(' ; ', CASE WHEN doc_id % 2 = 0 THEN 'Journal Article' ELSE ' journal article' END, CASE WHEN doc_id % 5 = 0 THEN 'Randomized Controlled Trial' END, "
    "CASE WHEN doc_id % 3 = 0 THEN 'Clinical Trial' END, CASE WHEN doc_id % 7 = 0 THEN 'Meta-Analysis' END, "
    "CASE WHEN doc_id % 4 = 0 THEN 'REVIEW' WHEN doc_id % 9 = 1 THEN 'Review Literature' END, CASE WHEN doc_id % 11 = 0 THEN 'Systematic Review' WHEN doc_id % 11 = 1 THEN 'Observational Study' END)"
)
JOURNAL = case("doc_id % 8", text(["acta test", "Annals of Tests", " J Sample Res", "Ward Notes", "J Other", "Clin Example "]))
YEAR = "CAST(1990 + doc_id % 36 AS INT)"
CITATION = case(
    "doc_id % 9",
    ["concat('J Test. ', CAST(" + YEAR + " AS STRING), ' Jan 5; 1(2):3-4')", "concat('Ann. Test Res. ', CAST(" + YEAR + " AS STRING), '; 7:1')", "concat('J Test. ', CAST(" + YEAR + " AS STRING), ' ;9')", "'J NoYear.;5'", "';'", "concat(CAST(" + YEAR + " AS STRING), ';')", "concat('  J Pad. ', CAST(" + YEAR + " AS STRING), ' Spring-Summer; 2')", "concat('J Long. ', CAST(" + YEAR + " AS STRING), ' Mar-Apr; 1')"],
)
ARTICLES = f"SELECT doc_id, {LINE} AS line, {TYPES} AS publication_type, {JOURNAL} AS journal, {YEAR} AS year FROM documents"
FILELIST = (
    f"SELECT doc_id, concat('PMC', {_ID}) AS accession, {case('doc_id % 6', [chr(39) + chr(39), chr(39) + '0' + chr(39), chr(39) + ' nan' + chr(39), chr(39) + 'None' + chr(39)], 'CAST(100 + doc_id % 500 AS STRING)')} AS pmid, "
    f"{CITATION} AS citation, CASE WHEN doc_id % 4 < 2 THEN {TYPES} WHEN doc_id % 4 = 2 THEN ' ' END AS publication_type FROM documents"
)
MEMBERS = (
    f"SELECT concat({case('doc_id % 3', text(['a_comm', 'b_noncomm', 'c_other']))}, '.tar') AS src_tar, doc_id AS member_pos, "
    "concat('d/', CASE WHEN doc_id % 11 = 0 THEN concat('notes', CAST(doc_id AS STRING), '.xml') WHEN doc_id % 10 = 3 THEN concat('pmc', CAST(doc_id - 3 AS STRING), '.XML') ELSE concat('PMC', CAST(doc_id AS STRING), '.xml') END) AS inner_path, "
    "doc_id % 29 <> 0 AS readable FROM documents"
)
#: The same with some members listed twice.
REPEATED = f"{MEMBERS} UNION ALL {MEMBERS} WHERE doc_id % 13 = 4"
_FLAG = lambda k, v: f"CASE WHEN doc_id % {k} = 0 THEN {v} ELSE '0' END"
LABELS = (
    f"SELECT doc_id, {case('doc_id % 3', [_ID, f'concat(' + chr(39) + 'pmc' + chr(39) + f', {_ID})'], f'concat(' + chr(39) + ' PMC' + chr(39) + f', {_ID})')} AS pmcid, "
    f"{case('doc_id % 7', [chr(39) + 'n/a' + chr(39), chr(39) + '2010.0' + chr(39), 'NULL'], 'CAST(' + YEAR + ' AS STRING)')} AS year, "
    f"{_FLAG(1, 'CASE WHEN doc_id % 19 = 0 THEN ' + chr(39) + '1.0' + chr(39) + ' ELSE ' + chr(39) + '1' + chr(39) + ' END')} AS all_article, {_FLAG(7, chr(39) + 'T' + chr(39))} AS meta_analysis, {_FLAG(4, chr(39) + ' yes' + chr(39))} AS review, "
    f"{_FLAG(6, chr(39) + 'true' + chr(39))} AS clinical_useful_journal, {_FLAG(5, chr(39) + 'Y' + chr(39))} AS randomized_controlled_trial, {_FLAG(10, chr(39) + 'no' + chr(39))} AS clinical_trial "
    "FROM documents WHERE doc_id % 17 <> 0"
)


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A carrier over the driver's tables."""
    name = sql.rsplit(" FROM ", 1)[1].split()[0]
    return spark.sql(sql.replace(f" FROM {name}", " FROM {src}"), src=table(spark, sf_dir, name))
