"""Incremental routing: each member applied exactly once, each id accepted once.

A stream remembers members and ids in Structured Streaming's state (RocksDB), so a
batch costs what it holds, however much was routed before: repeated members are
dropped by their (src_tar, inner_path), and of an id the first copy alone is
judged. Both are keys of one ``dropDuplicates``, so no Python runs for an id. State and outputs go together: a batch that is repeated after a failure
meets the state that it met before, and all its outputs are folders of its run
and number that are overwritten. The ledger is written last, and a batch without it is not part of the tables.

A new checkpoint is a new run with a state of its own; what older runs routed it
knows from the ledger, which no run but theirs adds to. :meth:`Router.process` routes single batches without a stream, by the ledger alone.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigscan.operators.routing import ACCEPT, copies, decide, manifest, member_id, reasons, skipped
from sigscan.session import discard, exists, materialize

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEDGER = "src_tar string, inner_path string, pmcid string, run string, batch long"


class Router:
    """Routes members into ``path``: ledger, manifest, skipped, articles."""

    def __init__(self, spark: SparkSession, path: str, labels: DataFrame):
        self.spark, self.path, self.labels = spark, path.rstrip("/"), labels

    def ledger(self) -> DataFrame:
        """Members that were processed; an empty pmcid for unrecognized names."""
        if not exists(self.spark, f"{self.path}/ledger"):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger")

    def process(self, members: DataFrame, batch: int, run: str = "0") -> None:
        """Route one batch: members in the ledger are skipped, ids in it are duplicates. Batches of a run are numbered upwards; a number that was processed is done again, as if those after it were not there."""
        before = self.ledger().where((F.col("run") != run) | (F.col("batch") < batch))
        fresh = members.join(before.select("src_tar", "inner_path"), ["src_tar", "inner_path"], "left_anti")
        self._write(decide(fresh, self.labels, before.select("pmcid")), batch, run)

    def _write(self, decided: DataFrame, batch: int, run: str) -> None:
        if "content" in decided.columns:  # nobody reads the others'
            decided = decided.withColumn("content", F.when(F.col("reason") == ACCEPT, F.col("content")))
        decided = materialize(decided, "decided")
        kept = [c for c in ("pmcid", "bucket", "year", "content") if c in (*decided.columns, "bucket")]
        entries = decided.select("src_tar", "inner_path", F.coalesce("pmcid", F.lit("")).alias("pmcid"))
        for name, df in (("manifest", manifest(decided)), ("skipped", skipped(decided)), ("articles", copies(decided).select(*kept)), ("ledger", entries)):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/run={run}/batch={batch}")
        discard(decided)

    def table(self, name: str) -> DataFrame:
        """All complete batches of an output, with their run and batch."""
        df = self.spark.read.parquet(f"{self.path}/{name}").withColumn("run", F.col("run").cast("string")).withColumn("batch", F.col("batch").cast("long"))
        return df.join(self.ledger().select("run", "batch").distinct(), ["run", "batch"], "left_semi")

    def _run_of(self, checkpoint: str) -> str:
        """The run that a checkpoint belongs to: a name kept beside it, so that a new checkpoint is a new run."""
        fs, base = pafs.FileSystem.from_uri(checkpoint if "://" in checkpoint else f"file://{checkpoint}")
        fs.create_dir(base, recursive=True)
        at = f"{base}/router-run"
        if fs.get_file_info(at).type == pafs.FileType.NotFound:
            with fs.open_output_stream(at, compression=None) as out:
                out.write(f"r{uuid.uuid4().hex}".encode())
        with fs.open_input_stream(at, compression=None) as f:
            return f.read().decode()

    def judged(self, members: DataFrame) -> DataFrame:
        """A stream of members with pmcid, each (src_tar, inner_path) once, and a row with ``__mark`` for each id that did not come before.

        Spark's own state keeps both kinds of keys; rows of members and marks are told apart by ``__mark``.
        """
        readable = F.col("readable") if "readable" in members.columns else F.lit(True)
        rows = members.withColumn("readable", readable).withColumn("pmcid", member_id(F.col("inner_path")))
        key = lambda mark, a, b: F.struct(F.lit(mark).alias("mark"), a.cast("string").alias("a"), b.cast("string").alias("b"))
        member, mark = key(False, F.col("src_tar"), F.col("inner_path")), key(True, F.col("pmcid"), F.lit(None))
        keyed = rows.withColumn("__key", F.explode(F.when(F.col("pmcid").isNull(), F.array(member)).otherwise(F.array(member, mark))))
        # a mark has its id alone
        plain = [F.col("pmcid") if c == "pmcid" else F.when(~F.col("__key.mark"), F.col(f"`{c}`")).alias(c) for c in rows.columns]
        return keyed.select(*plain, F.col("__key.mark").alias("__mark"), F.col("__key.a").alias("__a"), F.col("__key.b").alias("__b")).dropDuplicates(["__mark", "__a", "__b"]).drop("__a", "__b")

    def _route(self, judged: DataFrame, batch: int, run: str, older: DataFrame | None) -> None:
        came = materialize(judged, "batch")  # a batch is read several times, its state only once
        rows, new = came.where("not __mark").drop("__mark"), came.where("__mark").select("pmcid")
        # the first copy of each new id is judged; the minimum combines before the shuffle, and rows are unique by archive and path
        first = rows.where("pmcid is not null").groupBy("pmcid").agg(F.min(F.struct("src_tar", "member_pos", "inner_path")).alias("f")).join(new, "pmcid", "left_semi")
        first = first.select(F.col("f.src_tar").alias("__src"), F.col("f.inner_path").alias("__path"), F.lit(False).alias("__again"))
        judged = rows.join(first, F.col("src_tar").eqNullSafe(F.col("__src")) & F.col("inner_path").eqNullSafe(F.col("__path")), "left")
        judged = judged.withColumn("again", F.coalesce("__again", F.col("pmcid").isNotNull())).drop("__src", "__path", "__again")
        if older is not None:
            judged = judged.join(older.select("src_tar", "inner_path"), ["src_tar", "inner_path"], "left_anti")
            known = older.where("pmcid <> ''").select(F.col("pmcid").alias("__seen")).distinct()
            judged = judged.join(known, F.col("pmcid") == F.col("__seen"), "left").withColumn("again", F.col("again") | F.col("__seen").isNotNull()).drop("__seen")
        self._write(reasons(judged, self.labels, "again"), batch, run)
        discard(came)

    def stream(self, members: DataFrame, checkpoint: str):
        """Process a streaming DataFrame of members until it is exhausted; returns the finished query."""
        run = self._run_of(checkpoint)
        older = self.ledger().where(F.col("run") != run)
        older = older if older.head(1) else None  # without older runs no batch reads the ledger
        before = self.spark.conf.get(_PROVIDER, None)
        self.spark.conf.set(_PROVIDER, _ROCKSDB)
        try:
            query = self.judged(members).writeStream.foreachBatch(lambda df, n: self._route(df, n, run, older)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        finally:
            self.spark.conf.set(_PROVIDER, before) if before else self.spark.conf.unset(_PROVIDER)
        query.awaitTermination()
        return query
