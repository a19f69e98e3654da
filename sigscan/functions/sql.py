"""The library's functions in SQL: ``register(spark)`` makes them temporary functions of a session.

Column functions become SQL functions, which the optimizer inlines like the columns that they
come from: ``pvalues(line)``, ``pvalue_bin(p)``, ``citation_valid(c)``,
``citation_journal(c)``, ``citation_year(c)``, ``article_categories(types,
journal_flag)``. Two table functions take their rows in partitions: ``tar_index(path)``
gives the members of an archive, and ``request_chunks(size, TABLE(t) PARTITION BY k ORDER BY id)``
numbers the rows of each partition in requests of ``size``.
"""

from __future__ import annotations

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from sigscan.functions import citation
from sigscan.functions.bins import BINS, OVERFLOW, WIDTH
from sigscan.functions.categories import CATEGORIES, SEPARATOR
from sigscan.functions.pvalues import _AFTER_P, _SCAN, TYPE
from sigscan.functions.text import SPACES, W
from sigscan.session import ship


def _text(value: str) -> str:
    """A SQL string whose backslashes stand for themselves."""
    return "r'" + value.replace("'", "''") + "'" if "'" not in value else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _trim(x: str) -> str:
    return f"btrim({x}, '" + "".join(f"\\u{ord(c):04x}" for c in SPACES) + "')"


def _number(x: str) -> str:
    return f"regexp_replace(translate({x}, ',•x×E()', '..eee'), {_text(W + '+')}, '')"


_GROUPS = "split(regexp_replace(m, " + _text(f"^[Pp]{_AFTER_P}$") + ", '" + "\\u0001".join(f"${k}" for k in range(1, 8)) + "'), '\\u0001')"
_DIGITS, _POWER = _number("g[1]"), f"coalesce(nullif({_number('g[6]')}, ''), '1')"
_VALUE = (
    f"CASE WHEN length({_DIGITS}) - length(replace({_DIGITS}, '.', '')) > 1 THEN NULL ELSE try_cast({_DIGITS} AS DOUBLE) END * "
    "CASE WHEN g[2] <> '' THEN CAST(0.01 AS DOUBLE) WHEN g[3] = '' AND g[5] = '' THEN CAST(1 AS DOUBLE) "
    f"WHEN coalesce(try_cast(nullif(g[4], '') AS DOUBLE), 0) IN (0, 10) THEN try_cast(concat('1e', {_POWER}) AS DOUBLE) ELSE pow(try_cast(g[4] AS DOUBLE), try_cast({_POWER} AS DOUBLE)) END"
)
_OPERATOR = "CASE WHEN rlike(g[0], '[<≤]|less') AND rlike(g[0], '[>≥]') THEN 'ambiguous' WHEN rlike(g[0], '[<≤]|less') THEN '<' WHEN rlike(g[0], '[>≥]') THEN '>' ELSE '=' END"
_PVALUES = (
    f"coalesce(filter(transform(transform(regexp_extract_all(line, {_text(_SCAN)}, 0), m -> {_GROUPS}), g -> named_struct('p', {_VALUE}, 'op', {_OPERATOR})), v -> v.p > 0 AND v.p < 1), CAST(array() AS {TYPE}))"
)


def _group(k: int) -> str:
    return f"nullif({_trim(f'regexp_extract({_trim(chr(99))}, {_text(citation.PATTERN)}, {k})')}, '')"


def _categories() -> str:
    types = f"filter(transform(split(coalesce(types, ''), '{SEPARATOR}'), t -> lower({_trim('t')})), t -> t <> '')"
    has = lambda v: f"array_contains({types}, '{v}')"
    cases = {c.key: has(c.has) + (f" AND NOT {has(c.without)}" if c.without else "") for c in CATEGORIES if c.has} | {"all": "true", "cuj": "coalesce(core_journal, false)"}
    return "array_sort(array_compact(array(" + ", ".join(f"CASE WHEN {cases[c.key]} THEN '{c.bucket}' END" for c in CATEGORIES) + ")))"


#: Name and parameters, type, and the expression.
FUNCTIONS = [
    ("pvalues(line STRING)", TYPE, _PVALUES),
    ("pvalue_bin(p DOUBLE)", "STRING", f"concat('0.', lpad(CAST(CASE WHEN p <= {WIDTH * BINS}D THEN least({BINS}, greatest(1, CAST(ceil(p / {WIDTH}D) AS INT))) ELSE {OVERFLOW} END AS STRING), 3, '0'))"),
    ("citation_valid(c STRING)", "BOOLEAN", f"coalesce(rlike({_trim('c')}, {_text(citation.PATTERN)}), false)"),
    ("citation_journal(c STRING)", "STRING", _group(1)),
    ("citation_year(c STRING)", "STRING", _group(2)),
    ("article_categories(types STRING, core_journal BOOLEAN)", "ARRAY<STRING>", _categories()),
]


class TarIndex:
    """(inner_path, member_pos, offset, size) of the article files of an archive; only headers are read of one that is not compressed."""

    def eval(self, path: str):
        from sigscan.sources.archives import index_of

        yield from index_of(path, ".xml") if path else ()


class RequestChunks:
    """(id, chunk): the first column of the rows of a partition with the number of their request, of ``size`` rows."""

    def __init__(self):
        self.n = 0

    def eval(self, size: int, row: Row):
        yield str(row[0]), self.n // size
        self.n += 1


def register(spark: SparkSession) -> None:
    """Make all functions known to the session's SQL."""
    ship(spark)
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("tar_index", udtf(TarIndex, returnType="inner_path string, member_pos bigint, offset bigint, size bigint"))
    spark.udtf.register("request_chunks", udtf(RequestChunks, returnType="id string, chunk bigint"))


def call(name: str, *columns: Column) -> Column:
    """A registered function as a column."""
    return F.call_function(name, *columns)
