"""Places of rows within ordered groups of any size, and what is built on them: segments, ordered concatenation, ordered files.

No group is gathered: rows are dealt by ranges of (group, order), so a group that
holds most of the table lies in many partitions, and a partition adds to its own
numbers what the partitions before it hold of its first group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigscan.session import materialize, partitions_for, ship


def _changes(batch: pa.RecordBatch, by: list[str], before: list | None) -> np.ndarray:
    """Whether each row begins another group than the row before it; ``before`` holds the keys of the row before the batch."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = before is None
    for k, name in enumerate(by):
        c = batch.column(name)
        if before is not None and c[0].as_py() != before[k]:
            out[0] = True
        same, nulls = pc.fill_null(pc.equal(c[1:], c[:-1]), False), c.is_null().to_numpy(zero_copy_only=False)
        out[1:] |= ~(same.to_numpy(zero_copy_only=False) | (nulls[1:] & nulls[:-1]))
    return out


def positions(df: DataFrame, by: list[str], order: list[str | Column], name: str = "pos", partition_bytes: int = 64 << 20) -> DataFrame:
    """Add ``name``: the place, from 0, of each row in its group by ``order``; without ``by`` in the whole table.

    Nulls are a group of their own and come first; rows that tie get their places
    in no certain order, so give an order without ties where they differ. The result is written to
    the shared folder, sorted within its files, files in order.
    """
    ship(df.sparkSession)
    keys = [*[F.col(f"`{b}`").asc_nulls_first() for b in by], *[F.col(o).asc_nulls_first() if isinstance(o, str) else o for o in order]]
    part, at, first = (f"__{name}_{x}" for x in ("part", "at", "first"))
    dealt = df.repartitionByRange(partitions_for(df, partition_bytes), *keys).sortWithinPartitions(*keys)
    schema = T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(at, T.LongType()), T.StructField(first, T.BooleanType())])

    def run(batches):
        from pyspark import TaskContext

        task, before, n, is_first = TaskContext.get().partitionId(), None, 0, True
        for b in batches:
            if not b.num_rows:
                continue
            begins = _changes(b, by, before)
            idx = np.arange(b.num_rows)
            place = idx - np.maximum.accumulate(np.where(begins, idx, -n))
            in_first = np.full(b.num_rows, is_first)
            if begins[1:].any() or (before is not None and begins[0]):
                in_first &= np.cumsum(begins) - (before is None) < 1
            n, is_first, before = int(place[-1]) + 1, bool(in_first[-1]), [b.column(k)[-1].as_py() for k in by]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, task, np.int32)), pa.array(place), pa.array(in_first)], [*b.schema.names, part, at, first])

    written = materialize(dealt.mapInArrow(run, schema), "placed")
    held = written.groupBy(*[f"`{b}`" for b in by], part).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*[F.col(f"`{b}`") for b in by]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition at most: a group that comes from the partition before can only be the first of its own
    carried = held.select(F.col(part).alias(f"{part}_of"), F.sum("n").over(before).alias("__base")).where("`__base` > 0")
    out = written.join(F.broadcast(carried), F.col(part) == F.col(f"{part}_of"), "left")
    place = F.col(at) + F.when(F.col(first), F.coalesce("__base", F.lit(0))).otherwise(0)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name))


def ordered_segments(df: DataFrame, by: list[str], order: list[str | Column], text: str, sep: str = "\n", rows: int = 4096) -> DataFrame:
    """(by, segment, text): the texts of each group in order, joined in segments of ``rows`` rows; null is empty.

    What is gathered at once is a segment, so a group may be of any size.
    """
    placed = positions(df.select(*[F.col(f"`{b}`") for b in by], *_order_columns(order), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text")), by, [f"__o{k}" for k in range(len(order))])
    return _joined(placed.withColumn("segment", F.floor(F.col("pos") / rows)), by, sep)


def _order_columns(order: list[str | Column]) -> list[Column]:
    return [(F.col(f"`{o}`") if isinstance(o, str) else o).alias(f"__o{k}") for k, o in enumerate(order)]


def _joined(placed: DataFrame, by: list[str], sep: str) -> DataFrame:
    """Join the texts of a (by, segment) in the order of pos."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "__text")))
    return placed.groupBy(*[f"`{b}`" for b in by], "segment").agg(F.array_join(F.transform(parts, lambda x: x["__text"]), sep).alias("text"))


def ordered_concat(df: DataFrame, by: list[str], order: list[str | Column], text: str, sep: str = "\n", rows: int = 4096) -> DataFrame:
    """(by, text): the segments of :func:`ordered_segments` joined again, ``rows`` of them at once, until each group has one."""
    out = ordered_segments(df, by, order, text, sep, rows)
    last = out.agg(F.max("segment")).first()[0] or 0
    while last:
        again = out.select(*[F.col(f"`{b}`") for b in by], F.col("segment").alias("pos"), F.floor(F.col("segment") / rows).alias("segment"), F.col("text").alias("__text"))
        out, last = _joined(again, by, sep), last // rows
    return out.drop("segment")
