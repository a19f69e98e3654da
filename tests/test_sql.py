"""SQL functions against the columns that they stand for, and table functions."""

import io
import tarfile

from pyspark.sql import functions as F

from sigscan.functions import citation, sql
from sigscan.functions.bins import bin_index, bin_label
from sigscan.functions.categories import bucket_array, type_flags
from sigscan.functions.pvalues import extract_pvalues
from sigscan.plans.carriers import ARTICLES, FILELIST, derive


def test_functions_equal_columns(spark, sf):
    sql.register(spark)
    arts = derive(spark, sf, ARTICLES)
    arts.createOrReplaceTempView("arts")
    derive(spark, sf, FILELIST).createOrReplaceTempView("filelist")
    got = spark.sql("SELECT doc_id, pvalues(line) AS pv, article_categories(publication_type, doc_id % 6 = 0) AS c FROM arts")
    flags = {k: v == 1 for k, v in type_flags(F.col("publication_type")).items()} | {"clinical_useful_journal": F.col("doc_id") % 6 == 0}
    want = arts.select("doc_id", extract_pvalues(F.col("line")).alias("pv"), bucket_array(flags).alias("c"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0
    cited = spark.sql("SELECT citation_valid(citation) AS v, citation_journal(citation) AS j, citation_year(citation) AS y, citation AS c FROM filelist")
    c = F.col("c")
    assert cited.where(~(F.col("v").eqNullSafe(citation.is_valid(c)) & F.col("j").eqNullSafe(citation.journal(c)) & F.col("y").eqNullSafe(citation.year(c)))).count() == 0
    assert cited.where("v").count() and cited.where("not v").count()
    bins = spark.sql("SELECT p, pvalue_bin(p) AS b FROM (SELECT explode(array(0.001D, 0.0010001D, 0.05D, 0.06D, 1e-9D)) AS p)")
    assert bins.where(F.col("b") != bin_label(bin_index(F.col("p")))).count() == 0


def test_functions_are_inlined(spark, sf):
    """No function call is left in the plan, and no Python."""
    sql.register(spark)
    derive(spark, sf, ARTICLES).createOrReplaceTempView("arts")
    plan = spark.sql("SELECT pvalues(line) AS pv FROM arts")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" in plan and "Python" not in plan and "Arrow" not in plan


def test_table_functions(spark, tmp_path):
    sql.register(spark)
    for name in ("a", "b"):
        with tarfile.open(tmp_path / f"{name}.tar", "w") as tar:
            for k in range(5):
                info = tarfile.TarInfo(f"PMC{k}.xml" if k else "note.txt")
                info.size = 10 * k
                tar.addfile(info, io.BytesIO(b"x" * 50))
    spark.createDataFrame([(f"file://{tmp_path}/{n}.tar",) for n in "ab"], "path string").createOrReplaceTempView("tars")
    got = sorted((r.path[-5:], r.inner_path, r.member_pos, r.size) for r in spark.sql("SELECT path, i.* FROM tars, LATERAL tar_index(path) i").collect())
    assert got == [(f"{n}.tar", f"PMC{k}.xml", k, 10 * k) for n in "ab" for k in range(1, 5)]
    spark.range(100).selectExpr("id", "id % 3 AS k").createOrReplaceTempView("ids")
    rows = spark.sql("SELECT * FROM request_chunks(10, TABLE(SELECT id, k FROM ids) PARTITION BY k ORDER BY id)").collect()
    assert sorted((int(r.id), r.chunk) for r in rows) == [(i, i // 3 // 10) for i in range(100)]
