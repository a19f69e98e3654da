"""Every query of the literature pipeline runs, and equals its SQL where it has some."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from conftest import compare
from sigscan.plans import catalogue, connectors


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("langs", [["de", None, "", "a/b c%", "1", "é"], ["1", "01", "2.0", "2", "03", "1e3"]])
def test_folder_rewrite_of_odd_texts(spark, tmp_path, langs):
    # a language a text: each begins a file
    texts = ["a\n\nb\r\n \t\nc\r\rd", "\ufeffmarked\n\ufeff", "", None, "\u3000\n\x1c\x1ae\x1a0\x1a1", "plain\n"]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts, "lang": langs}), tmp_path / "documents.parquet")
    compare(spark, str(tmp_path), connectors.folder_rewrite, catalogue.ORACLES["folder_rewrite"])
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts[::-1], "lang": langs}), tmp_path / "documents.parquet")
    compare(spark, str(tmp_path), connectors.folder_rewrite, catalogue.ORACLES["folder_rewrite"])


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["category", "year"]
    assert set(e.oracle_sql()) <= set(e.queries())
