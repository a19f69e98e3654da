import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def compare(spark, sf_dir: str, run, sql: str) -> None:
    """A query's rows against DuckDB's, in any order, columns by name."""
    import duckdb

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = run(spark, sf_dir)
    cols = sorted(got.columns)
    want = con.sql(f"select {', '.join(cols)} from ({sql})")
    assert sorted(want.columns) == cols
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted([tuple(plain(r[c]) for c in cols) for r in got.collect()], key=key)
    b = sorted([tuple(plain(v) for v in r) for r in want.fetchall()], key=key)
    assert a == b
