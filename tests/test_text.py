"""Text functions: the same as Python's, and linear on long runs."""

import random
import time

from pyspark.sql import functions as F

from sigscan.functions.text import SPACES, W, clean_text, first_token, line_count, not_blank, page_text, trim_ws


def test_trim_equals_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice([*SPACES, "a", "é", "x y"]) for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", trim_ws(F.col("t")).alias("a"), F.regexp_replace("t", f"^{W}+|{W}+$", "").alias("b"), not_blank(F.col("t")).alias("c")).collect():
        assert r.a == r.t.strip() == r.b and r.c == bool(r.t.strip())


def test_long_runs_take_linear_time(spark):
    mb = 1 << 20
    pages = [("<!--" * (mb // 4), ""), ("<script " * (mb // 8), ""), ("<body " * (mb // 6), None), ("<" * mb, "<" * mb), ("</body  " * (mb // 8), None), ("<style>" * (mb // 7) + "</style>z", "z"), ("a<p>b" * (mb // 5), None)]
    df = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(pages)], "k int, p string").repartition(7)
    df.select(page_text(F.lit("<p>x</p>"))).collect()
    began = time.perf_counter()
    got = {r.k: r.t for r in df.select("k", page_text(F.col("p")).alias("t")).collect()}
    blank = spark.createDataFrame([("x" + " " * mb + "y\n" + "　" * mb,)], "t string")
    row = blank.select(trim_ws(F.col("t")).alias("a"), clean_text(F.col("t")).alias("b"), first_token(F.col("t")).alias("c"), line_count(F.col("t")).alias("d")).first()
    assert time.perf_counter() - began < 20
    assert all(want is None or got[k] == want for k, (_, want) in enumerate(pages))
    assert (len(row.a), row.b, row.c, row.d) == (mb + 2, "x y", "x", 1)


def test_pages(spark):
    cases = {"<html><body class='a'> x <b>y</b><!-- n --><script>s</script> z </body> tail": "x y z", "no tags": "no tags", "a < b": "a < b", "<p>1</p> < 2": "1 < 2", "a<!-- open": "a", "<body>q<style>w": "q", None: "", "<BODY>k</BODY >m<p>": "k"}
    df = spark.createDataFrame([(c,) for c in cases], "h string")
    assert {r.h: r.t for r in df.select("h", page_text(F.col("h")).alias("t")).collect()} == cases
