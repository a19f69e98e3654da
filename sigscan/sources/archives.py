"""Tar archives of article XML: an index of members, reading by ranges, integrity, jobs, export."""

from __future__ import annotations

import gzip
import io
import tarfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigscan.session import materialize, ship
from sigscan.sources.listing import _batch, list_files, located

MEMBERS = "src_tar string, inner_path string, member_pos long, readable boolean, content binary"
#: A member's place: ``offset`` and ``size`` of its bytes in an archive that is not compressed, null in one that is (``size`` is known in both).
INDEX = "path string, inner_path string, member_pos long, offset long, size long"
_KINDS = (".tar", ".tgz", ".tar.gz", ".tar.bz2", ".tar.xz")
#: Bytes of members that a task reads, and of a batch of them.
RANGE_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
#: Members of an archive that is written.
MAX_MEMBERS = 100_000


def list_archives(spark: SparkSession, path: str, kinds: tuple[str, ...] = _KINDS) -> DataFrame:
    """(path, field, year) of archives below ``path``: the field is their folder, the year their stem. Tasks list the folders; bytes are not read."""
    files = list_files(spark, path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.where(F.lower(name).rlike(r"\.(tar|tgz|tar\.gz|tar\.bz2|tar\.xz)$") & F.lower(name).rlike("|".join(k.replace(".", r"\.") + "$" for k in kinds))).select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("field"), F.regexp_replace(name, r"(?i)\.(tar|tgz|tar\.gz|tar\.bz2|tar\.xz)$", "").alias("year"))


def open_uri(uri: str):
    """A readable stream of a file by URI, on an executor."""
    fs, at = located(uri)
    return fs.open_input_stream(at, compression=None)


def index_of(path: str, suffix: str):
    """(inner_path, member_pos, offset, size) of the wanted members of an archive. Of one that is not compressed only the headers are read, the rest is skipped over."""
    fs, at = located(path)
    with fs.open_input_file(at) as f:
        if not f.size():  # an empty file has no members
            return
        plain = _is_plain(f)
        f.seek(0)
        with tarfile.open(fileobj=f, mode="r:" if plain else "r|*") as tar:
            for pos, m in enumerate(tar):
                if plain:
                    tar.members = []  # an archive of millions of members is not kept
                if m.isfile() and m.name.lower().endswith(suffix):
                    yield m.name, pos, m.offset_data if plain and not m.issparse() else None, m.size


def _is_plain(f) -> bool:
    """Whether a file begins with a tar header as it is; an empty one does not matter."""
    head = f.read(512)
    try:
        return len(head) == 512 and (not head.strip(b"\0") or tarfile.TarInfo.frombuf(head, "utf-8", "surrogateescape") is not None)
    except tarfile.TarError:
        return False


def index_archives(archives: DataFrame, suffix: str = ".xml") -> DataFrame:
    """(path, inner_path, member_pos, offset, size) of the regular members named ``*.xml`` (any case) of archives (path), written to the shared folder: a table of places, with which any task reads any member."""
    ship(archives.sparkSession)
    schema = pa.schema([("path", pa.string()), ("inner_path", pa.string()), ("member_pos", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())])

    def run(batches):
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                for row in index_of(path, suffix):
                    rows.append((path, *row))
                    if len(rows) >= 8192:
                        yield _batch(rows, schema)
                        rows = []
            if rows:
                yield _batch(rows, schema)

    return materialize(archives.select("path").repartition(_tasks(archives), "path").mapInArrow(run, INDEX), "tar-index")


def _tasks(archives: DataFrame) -> int:
    """A task an archive, up to a number that a driver can look after."""
    return max(1, min(archives.count(), 32 * archives.sparkSession.sparkContext.defaultParallelism))


def contents(rows):
    """The rows (path, inner_path, member_pos, offset, size) with the members' bytes. Rows of an archive come in order, so a file is opened once and a compressed one is streamed once."""
    now, handles, stream = None, [], None
    try:
        for path, inner, pos, offset, size in rows:
            if path != now:
                _close(handles)
                fs, at = located(path)
                now, stream = path, None
                handles.append(fs.open_input_file(at))
            if offset is not None:
                handles[0].seek(offset)
                data = handles[0].read(size)
                if len(data) != size:
                    raise OSError(f"{path} ends inside {inner}")
            else:
                if stream is None:
                    handles.append(fs.open_input_stream(at, compression=None))
                    handles.append(tarfile.open(fileobj=handles[1], mode="r|*"))
                    stream = enumerate(handles[2])
                m = next(m for k, m in stream if k == pos)
                x = handles[2].extractfile(m)
                data = x.read() if x else None
            yield path, inner, pos, data
    finally:
        _close(handles)


def _close(handles: list) -> None:
    while handles:
        handles.pop().close()


def ranges(index: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Add ``part`` to an index: members of one archive that lie in the same ``range_bytes`` of it; a compressed archive is one part, as it can only be read from its start."""
    return index.withColumn("part", F.coalesce(F.floor(F.col("offset") / F.lit(range_bytes)), F.lit(0)).cast("long"))


def read_members(index: DataFrame, by_path: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(src_tar, inner_path, member_pos, readable, content) of the members of an index, or of any rows of it: a large archive is read by many tasks, each its ranges of bytes."""
    ship(index.sparkSession)
    schema = pa.schema([("src_tar", pa.string()), ("inner_path", pa.string()), ("member_pos", pa.int64()), ("readable", pa.bool_()), ("content", pa.binary())])

    def run(batches):
        out, size = [], 0
        for path, inner, pos, data in contents(r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)):
            out.append((path if by_path else path.rsplit("/", 1)[-1], inner, pos, data is not None, data))
            size += len(data or b"") + 200
            if size > BATCH_BYTES:
                yield _batch(out, schema)
                out, size = [], 0
        if out:
            yield _batch(out, schema)

    placed = ranges(index, range_bytes)
    n = max(index.sparkSession.sparkContext.defaultParallelism, placed.select("path", "part").distinct().count())
    dealt = placed.repartition(n, "path", "part").sortWithinPartitions("path", "member_pos")
    return dealt.select("path", "inner_path", "member_pos", "offset", "size").mapInArrow(run, MEMBERS)


def members(archives: DataFrame, content: bool = True, suffix: str = ".xml", by_path: bool = True) -> DataFrame:
    """The regular members named ``*.xml`` (any case) of archives (path); ``content=False`` lists without reading.

    ``by_path=False`` gives an archive's base name as src_tar, for archives whose names differ. Listing first and
    reading only what is routed is two cheap passes instead of one that carries every member's bytes through the decisions.
    """
    index = index_archives(archives, suffix)
    if content:
        return read_members(index, by_path)
    src = F.col("path") if by_path else F.regexp_extract("path", r"([^/]+)$", 1)
    return index.select(src.alias("src_tar"), "inner_path", "member_pos", F.lit(True).alias("readable"), F.lit(None).cast("binary").alias("content"))


class _Unpacked(io.RawIOBase):
    """What a compressed stream holds, and whether its checksums hold (``failed``); a failure looks like an end."""

    def __init__(self, raw):
        self.z, self.failed = gzip.open(io.BufferedReader(raw), "rb"), False

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        try:
            return b"" if self.failed else self.z.read(size)
        except Exception:  # noqa: BLE001  any failure of the first test is its verdict
            self.failed = True
            return b""


def check_archives(archives: DataFrame) -> DataFrame:
    """(path, status) of compressed archives: ok, gzip_failed (checksum) or tar_failed (structure). An archive is opened and unpacked once; memory holds a block."""
    ship(archives.sparkSession)

    def status(path: str) -> str:
        try:
            with open_uri(path) as raw:
                unpacked, sound = _Unpacked(raw), True
                try:
                    with tarfile.open(fileobj=unpacked, mode="r|") as tar:
                        for _ in tar:
                            tar.members = []  # they are not kept
                except Exception:  # noqa: BLE001
                    sound = False
                while unpacked.read(1 << 20):  # to the end, as the checksum comes last
                    pass
                return "gzip_failed" if unpacked.failed else "ok" if sound else "tar_failed"
        except Exception:  # noqa: BLE001  it can't be read
            return "gzip_failed"

    def run(batches):
        for b in batches:
            paths = b.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "status": pa.array([status(p) for p in paths], pa.string())})

    return archives.select("path").repartition(_tasks(archives), "path").mapInArrow(run, "path string, status string")


def export_tars(copied: DataFrame, folder: str, max_members: int = MAX_MEMBERS) -> DataFrame:
    """Write copies (bucket, year, pmcid, content) as tar archives ``bucket/year/part.tar`` in a shared folder: (path, members).

    A bucket of any size has as many archives as it needs; owners are zeroed. An
    archive is one task's, the largest buckets begin; contents move once.
    """
    ship(copied.sparkSession)
    year = F.coalesce(F.col("year").cast("string"), F.lit("unknown-year"))
    rows = copied.select("bucket", year.alias("year"), "pmcid", "content")
    sizes = rows.groupBy("bucket", "year").agg(F.count("*").alias("__n"))
    sizes = materialize(sizes.withColumn("__parts", F.ceil(F.col("__n") / F.lit(float(max_members)))), "sizes")  # so Spark knows how small it is
    n = min(sizes.agg(F.sum("__parts")).first()[0] or 1, 32 * copied.sparkSession.sparkContext.defaultParallelism)
    sizes = sizes.withColumn("__before", F.sum("__parts").over(Window.orderBy(F.desc("__n"), "bucket", "year")) - F.col("__parts")).drop("__n")  # a row a bucket and year
    parted = rows.join(sizes, ["bucket", "year"]).withColumn("__part", F.pmod(F.xxhash64("pmcid"), F.col("__parts")))
    dealt = parted.repartitionById(n, F.pmod(F.col("__before") + F.col("__part"), F.lit(n)).cast("int"))
    dealt = dealt.sortWithinPartitions("bucket", "year", "__part", "pmcid").select("bucket", "year", "__part", "pmcid", "content")

    def run(batches):
        from pyspark import TaskContext

        task, now, tar, out, n, done = TaskContext.get().partitionId(), None, None, None, 0, []
        fs, base = pafs.FileSystem.from_uri(folder)

        def close():
            if tar is not None:
                tar.close()
                out.close()
                fs.move(temp, f"{base}/{final}")
                done.append((f"{folder}/{final}", n))

        for b in batches:
            for bucket, year, part, pmcid, content in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if now != (bucket, year, part):
                    close()
                    now, n = (bucket, year, part), 0
                    final, temp = f"{bucket}/{year}/part-{part:05d}.tar", f"{base}/{bucket}/{year}/.{task}-{uuid.uuid4().hex}"
                    fs.create_dir(f"{base}/{bucket}/{year}", recursive=True)
                    out = fs.open_output_stream(temp, compression=None)
                    tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.PAX_FORMAT)
                info = tarfile.TarInfo(f"{pmcid}.xml")
                info.size = len(content or b"")
                tar.addfile(info, io.BytesIO(content or b""))
                n += 1
        close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done]), "members": pa.array([k for _, k in done], pa.int64())})

    return dealt.mapInArrow(run, "path string, members long")
