"""Places in ordered groups, segments and ordered concatenation, with groups over many partitions."""

from collections import defaultdict

from pyspark.sql import functions as F

from sigscan.operators import ordering


def rows():
    return [(None if i % 5 == 0 else (1 if i % 3 else i % 7), i * 37 % 1000, f"t{i}" if i % 11 else None) for i in range(4000)]


def groups():
    by = defaultdict(list)
    for g, k, t in rows():
        by[g].append((k, t is not None, t or ""))
    return {g: sorted(v) for g, v in by.items()}


def test_positions_of_groups_over_many_partitions(spark):
    df = spark.createDataFrame(rows(), "g long, k long, t string").repartition(9)
    placed = ordering.positions(df, ["g"], ["k", "t"], partition_bytes=2000)
    got = defaultdict(dict)
    for r in placed.collect():
        got[r.g][r.pos] = (r.k, r.t is not None, r.t or "")
    assert {g: [v[k] for k in range(len(v))] for g, v in got.items()} == groups()
    # one group, over all partitions
    hot = ordering.positions(spark.range(5000).select(F.lit(1).alias("g"), (F.col("id") * 7 % 5000).alias("k")), ["g"], ["k"], partition_bytes=1000)
    assert hot.where("pos <> k").count() == 0 and hot.count() == 5000
    assert ordering.positions(df.where("false"), ["g"], ["k"]).count() == 0
    assert sorted(r.pos for r in ordering.positions(df, [], ["k", "t"], partition_bytes=2000).collect()) == list(range(4000))


def test_concatenation_in_segments(spark):
    df = spark.createDataFrame(rows(), "g long, k long, t string").repartition(5)
    got = {r.g: r.text for r in ordering.ordered_concat(df, ["g"], ["k", F.col("t")], "t", rows=7).collect()}
    assert got == {g: "\n".join(t for _, _, t in v) for g, v in groups().items()}
    parts = ordering.ordered_segments(df, ["g"], ["k", "t"], "t", rows=7).where("g = 1").orderBy("segment").collect()
    assert "\n".join(r.text for r in parts) == got[1] and max(r.text.count("\n") for r in parts) == 6


def test_concatenation_of_one_very_long_group(spark):
    """A million turns of one conversation; no task gathers more than a segment."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(5).alias("conv_id"), (n - F.col("id")).alias("turn"), F.col("id").cast("string").alias("text"))
    parts = ordering.ordered_segments(df, ["conv_id"], ["turn"], "text")
    assert parts.count() == -(-n // 4096)
    assert parts.where("segment = 1").first().text.split("\n") == [str(n - 1 - k) for k in range(4096, 8192)]
