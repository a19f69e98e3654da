"""Files below a folder, listed and read by tasks. The driver learns how many folders are left, never the files' names."""

from __future__ import annotations

import re
from collections import deque
from fnmatch import fnmatchcase
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigscan.session import materialize, qualified, ship

#: Folders that a task walks below each one that it gets; what it has not walked by then is handed over.
WALK = 4096
#: Bytes of files that a task reads (a file counts as ``FILE_BYTES`` more), and of a batch of them.
TASK_BYTES, FILE_BYTES, BATCH_BYTES = 32 << 20, 16 << 10, 4 << 20
_FOUND = pa.schema([("path", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])
_READ = pa.schema([("path", pa.string()), ("content", pa.binary())])


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):  # as Hadoop reads them: names may hold blanks and percent signs
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _prefix(uri: str) -> str | None:
    """What stands before the paths of a file system in their URIs; null for patterns and stores that only Spark reads."""
    if re.search(r"[*?{\[]", uri):
        return None
    try:
        _, at = located(uri)
    except pa.ArrowInvalid:
        return None
    return uri.removesuffix(at) if uri.endswith(at) else None


def _hidden(name: str) -> bool:
    """Names that Spark's readers skip."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def by_spark(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Spark's own reader, which keeps the names of all files on the driver."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, size) of the files below ``folder`` whose names match ``glob``, written to the shared folder.

    Tasks walk the folders: the first lists the top, then each takes some of the
    folders found and walks what is below them, and hands over what it has not
    walked after ``WALK`` folders. A folder's own entries are one task's.
    Patterns of folders, and stores that only Spark reads, are left to Spark,
    whose reader leaves out empty files; here they are listed.
    """
    folder = qualified(spark, folder)
    prefix = _prefix(folder)
    if prefix is None:
        return by_spark(spark, folder, glob).select("path", F.col("length").alias("size"))
    ship(spark)
    fs, at = located(folder)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(folder)
    if info.type == pafs.FileType.File:
        return spark.createDataFrame([(folder, info.size)] if fnmatchcase(info.base_name, glob) else [], "path string, size long")

    def walk(limit: int):
        def run(batches):
            rows = []
            for b in batches:
                for top in b.column(0).to_pylist():
                    waiting, n = deque([top]), 0
                    while waiting and n < limit:
                        n += 1
                        files, inner = located(waiting.popleft())
                        for x in files.get_file_info(pafs.FileSelector(inner)):
                            if _hidden(x.base_name):
                                continue
                            if x.type == pafs.FileType.Directory:
                                waiting.append(prefix + x.path)
                            elif fnmatchcase(x.base_name, glob):
                                rows.append((prefix + x.path, x.size, False))
                        if len(rows) >= 8192:
                            yield _batch(rows, _FOUND)
                            rows = []
                    rows += [(x, None, True) for x in waiting]
            if rows:
                yield _batch(rows, _FOUND)

        return run

    found, left, limit = [], spark.createDataFrame([(folder,)], "path string"), 1
    while True:
        now = materialize(left.mapInArrow(walk(limit), "path string, size long, folder boolean"), "listed")
        found.append(now.where("not folder").select("path", "size"))
        n, limit = now.where("folder").count(), WALK
        if not n:
            return reduce(DataFrame.unionByName, found)
        left = now.where("folder").select("path").repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "path")


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, content) of the files of :func:`list_files`, in tasks of about ``TASK_BYTES``; each is opened once."""
    if _prefix(qualified(spark, folder)) is None:
        return by_spark(spark, folder, glob).select("path", "content")
    files = list_files(spark, folder, glob)

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = located(path)
                with fs.open_input_stream(at, compression=None) as f:
                    rows.append((path, f.read()))
                size += len(rows[-1][1]) + 200
                if size > BATCH_BYTES:
                    yield _batch(rows, _READ)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, _READ)

    total = files.agg(F.sum(F.col("size") + FILE_BYTES)).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return files.select("path").repartition(n, "path").mapInArrow(run, "path string, content binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
