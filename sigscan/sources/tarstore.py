"""A folder of tar archives by bucket and year that runs append to, each run whole or not at all.

``parts/<run>/<bucket>/<year>/`` holds the archives that a run wrote,
``manifest/run=<run>`` lists them, and ``commits/<run>.json``, written last and
by one rename, makes them part of the store. What a broken run left is never
read, and the same run may be done again. Compaction is such a run, whose commit also
says which ones it replaces, so a reader sees the archives before it or those after it.
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigscan.session import exists, materialize, remove, ship
from sigscan.sources.archives import MAX_MEMBERS, contents, export_tars, index_archives

PARTS = "path string, bucket string, year string, members long"


class TarStore:
    """Archives of articles in ``folder``, a URI that executors can write to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _commits(self) -> dict[str, list[str]]:
        """Committed runs with those that each replaces: one small file a run."""
        fs, base = pafs.FileSystem.from_uri(f"{self.folder}/commits")
        out = {}
        for info in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if info.base_name.endswith(".json"):
                with fs.open_input_stream(info.path, compression=None) as f:
                    out[info.base_name.removesuffix(".json")] = json.loads(f.read())["replaces"]
        return out

    def runs(self) -> list[str]:
        """The runs that the store consists of."""
        commits = self._commits()
        return sorted(set(commits) - {r for replaced in commits.values() for r in replaced})

    def _commit(self, run: str, replaces: list[str]) -> None:
        fs, base = pafs.FileSystem.from_uri(f"{self.folder}/commits")
        fs.create_dir(base, recursive=True)
        temp = f"{base}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(temp, compression=None) as out:
            out.write(json.dumps({"replaces": replaces}).encode())
        fs.move(temp, f"{base}/{run}.json")

    def parts(self) -> DataFrame:
        """(path, bucket, year, members) of the archives of the store."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], PARTS)
        return self.spark.read.schema(PARTS).parquet(*[f"{self.folder}/manifest/run={r}" for r in runs])

    def append(self, copied: DataFrame, run: str, max_members: int = MAX_MEMBERS) -> None:
        """Add copies (bucket, year, pmcid, content). A run that is committed is not done again; one that was broken off is done from its start."""
        if run in self._commits():
            return
        remove(self.spark, f"{self.folder}/parts/{run}")
        written = export_tars(copied, f"{self.folder}/parts/{run}", max_members)
        place = F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 2)
        written.select("path", place[0].alias("bucket"), place[1].alias("year"), "members").write.mode("overwrite").parquet(f"{self.folder}/manifest/run={run}")
        self._commit(run, [])

    def compact(self, run: str, max_members: int = MAX_MEMBERS) -> None:
        """Join the archives of each bucket and year that has several, up to ``max_members`` in one; other archives stay where they are.

        A task joins one group of archives as a stream: two files are open at a time, and one member is held.
        """
        if run in self._commits():
            return
        runs = self.runs()
        ship(self.spark)
        remove(self.spark, f"{self.folder}/parts/{run}")
        parts = materialize(self.parts(), "parts")
        # archives of a bucket and year in the order of their paths, in groups of at most max_members
        before = F.sum("members").over(_of_bucket()) - F.col("members")
        grouped = parts.withColumn("group", F.floor(before / F.lit(max_members))).withColumn("n", F.count("*").over(_of_bucket("group").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        single, many = grouped.where("n = 1").drop("group", "n"), grouped.where("n > 1").select("bucket", "year", "group", "path")
        many = materialize(many, "joined")
        groups = many.select("bucket", "year", "group").distinct().count()
        folder = f"{self.folder}/parts/{run}"

        def join(batches):
            yield from _join((r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True)), folder)

        # archives that this store wrote are not compressed: an index has their members' places
        index = index_archives(many.select("path"), suffix="")
        dealt = index.join(many, "path").repartition(max(groups, 1), "bucket", "year", "group").sortWithinPartitions("bucket", "year", "group", "path", "member_pos")
        joined = dealt.select("path", "inner_path", "member_pos", "offset", "size", "bucket", "year", "group").mapInArrow(join, PARTS)
        joined.unionByName(single).write.mode("overwrite").parquet(f"{self.folder}/manifest/run={run}")
        self._commit(run, runs)

    def vacuum(self) -> None:
        """Remove archives that no reader finds any more: those of replaced runs that no manifest lists."""
        listed = {r.run for r in self.parts().select(F.regexp_extract("path", r"/parts/([^/]+)/", 1).alias("run")).distinct().collect()}
        fs, base = pafs.FileSystem.from_uri(f"{self.folder}/parts")
        if exists(self.spark, f"{self.folder}/parts"):
            for info in fs.get_file_info(pafs.FileSelector(base)):
                if info.base_name in self._commits() and info.base_name not in listed:
                    fs.delete_dir(info.path)


def _of_bucket(*more: str):
    return Window.partitionBy("bucket", "year", *more).orderBy("path")


def _join(rows, folder: str):
    """Write each group of members (path, inner_path, member_pos, offset, size, bucket, year, group), which come in order, as one archive."""
    fs, base = pafs.FileSystem.from_uri(folder)
    schema = pa.schema([("path", pa.string()), ("bucket", pa.string()), ("year", pa.string()), ("members", pa.int64())])
    for (bucket, year, group), members in groupby(rows, itemgetter(5, 6, 7)):
        at, name, n = f"{base}/{bucket}/{year}", f"part-{group:05d}.tar", 0
        fs.create_dir(at, recursive=True)
        temp = f"{at}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(temp, compression=None) as out, tarfile.open(fileobj=out, mode="w|", format=tarfile.PAX_FORMAT) as tar:
            for _, inner, _, data in contents(r[:5] for r in members):
                info = tarfile.TarInfo(inner)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
                n += 1
        fs.move(temp, f"{at}/{name}")
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{bucket}/{year}/{name}", "bucket": bucket, "year": year, "members": n}], schema)
