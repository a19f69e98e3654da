"""Line corpora (one article a line, category and year in the file name), id lists, text folders, CSV tables."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable
from contextlib import ExitStack, suppress
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigscan.functions.text import WS, clean_text, decode_text, not_blank, trim_ws
from sigscan.operators.metadata import union_filelists
from sigscan.session import exists, materialize, ship
from sigscan.sources.archives import RANGE_BYTES, contents, index_archives, open_uri, ranges
from sigscan.sources.listing import list_files, located, read_files
from sigscan.sources.xmltext import section_texts

#: File names: xtract list, category, year (or unknown-year), section for full-text archives.
_NAME = r"(pmcid|pmcxtract|pmid|pmxtract)_list_(.+?)_([0-9]{4}|unknown-year|unknown)(?:_(abstract|body))?\.txt$"


def _parts(df: DataFrame, *more: Column) -> DataFrame:
    path = F.col("_metadata.file_path")
    part = lambda k: F.nullif(F.regexp_extract(path, _NAME, k), F.lit(""))
    kind = part(1)
    source = F.when(kind.startswith("pmc"), F.concat(F.lit("pmc_"), part(4))).when(kind.isNotNull(), F.lit("pubmed_abstract"))
    return df.where(not_blank(F.col("value"))).select(trim_ws(F.col("value")).alias("line"), source.alias("source"), part(2).alias("category"), part(3).try_cast("int").alias("year"), *more)


def read_lines(spark: SparkSession, path: str | list[str], *more: Column) -> DataFrame:
    """(article_id, text, line, source, category, year) of line corpora, and ``more`` columns; blank lines are skipped, missing files are just absent."""
    lines = _parts(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*xtract_list_*.txt").text(path), *more)
    kept = [c for c in lines.columns if c not in ("line", "source", "category", "year")]
    head = F.regexp_extract("line", f"^[^{WS}]+", 0)
    return lines.select(head.alias("article_id"), trim_ws(F.substring("line", F.length(head) + 1, F.length("line"))).alias("text"), "line", "source", "category", "year", *kept)


def read_ids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(article_id, source, category, year) of id lists."""
    return _parts(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*id_list_*.txt").text(path)).withColumnRenamed("line", "article_id")


def write_lines(articles: DataFrame, path: str, mode: str = "append") -> None:
    """Write (article_id, category, year, abstract, body) as text partitioned by section, category and year, ids and texts apart.

    Texts that are empty after cleaning are left out.
    """
    long = articles.select("article_id", "category", F.coalesce(F.col("year").cast("string"), F.lit("unknown-year")).alias("year"), F.expr("stack(2, 'abstract', abstract, 'body', body) as (section, text)"))
    kept = long.withColumn("text", clean_text(F.col("text"))).where("text <> ''")
    kept.select("section", "category", "year", F.concat_ws(" ", "article_id", "text").alias("value")).write.mode(mode).partitionBy("section", "category", "year").text(f"{path}/texts")
    kept.select("section", "category", "year", F.col("article_id").alias("value")).write.mode(mode).partitionBy("section", "category", "year").text(f"{path}/ids")


def write_corpus(lines: DataFrame, folder: str, kind: str = "pmcxtract") -> DataFrame:
    """Write (category, year, section, line) as line corpora ``<task>/<kind>_list_<category>_<year>_<section>.txt``: (path, lines).

    Rows are dealt by key and salted, so that a hot key has many writers; each
    file gets its name when it is complete.
    """
    ship(lines.sparkSession)
    n = lines.sparkSession.sparkContext.defaultParallelism
    rows = lines.select("category", F.coalesce(F.col("year").cast("string"), F.lit("unknown-year")).alias("year"), "section", "line").withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(n)))
    dealt = rows.repartition("category", "year", "section", "salt").sortWithinPartitions("category", "year", "section").drop("salt")

    def run(batches):
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(folder)
        part, now, out, done = f"{TaskContext.get().partitionId():06d}", None, None, []

        def close():
            if out is not None:
                out.close()
                fs.move(temp, f"{base}/{done[-1][0]}")

        for b in batches:
            for *key, line in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if key != now:
                    close()
                    fs.create_dir(f"{base}/{part}", recursive=True)
                    now, temp = key, f"{base}/{part}/.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temp, compression=None)
                    done.append([f"{part}/{kind}_list_{'_'.join(filter(None, key))}.txt", 0])
                out.write(line.encode() + b"\n")
                done[-1][1] += 1
        close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{p}" for p, _ in done], "lines": pa.array([k for _, k in done], pa.int64())})

    return materialize(dealt.mapInArrow(run, "path string, lines long"), "corpus")


#: Bytes that a member counts as besides its own.
MEMBER_BYTES = 1 << 10
#: What a unit of work writes: the texts of each section, and the ids of the articles that have it.
_SECTIONS = ("abstract", "body")
DONE = "job string, path string, part long, category string, year string, articles long, abstract long, body long"


def convert_archives(archives: DataFrame, folder: str, unit_bytes: int = RANGE_BYTES, sections: Callable[[bytes], tuple[str | None, str | None]] = section_texts) -> DataFrame:
    """Write the texts of archives (path, category, year) of article XML that are not done yet; returns what this call did, as :func:`converted`.

    A unit of work is the members in one range of bytes of an archive. Its task
    writes its four outputs (texts and ids of abstracts and of bodies) to a
    folder of its own, each named when it is complete, and then its mark. So a run that
    is broken off keeps every unit that was finished, the next one does the
    others, and nothing that a unit left without its mark is ever read. Article
    texts are read and written one at a time. A task does units of about
    ``RANGE_BYTES`` together, one after another; when it is tried again it passes
    over those that have their mark.
    """
    spark = archives.sparkSession
    ship(spark)
    index = ranges(index_archives(archives.select("path").distinct()), unit_bytes)
    job = F.md5(F.concat_ws(":", "path", "part").cast("binary"))
    units = index.withColumn("job", job).join(archives.select("path", "category", F.coalesce(F.col("year").cast("string"), F.lit("unknown-year")).alias("year")).dropDuplicates(["path"]), "path")
    before = converted(spark, folder).select("job")
    columns = ["path", "inner_path", "member_pos", "offset", "size", "job", "part", "category", "year"]
    todo = materialize(units.join(before, "job", "left_anti").select(*columns), "units")
    left = todo.groupBy("job").agg(F.sum(F.col("size") + MEMBER_BYTES).alias("bytes"))
    k, total = left.agg(F.count("*"), F.sum("bytes")).first()
    n = max(1, min(k, max(-(-(total or 0) // RANGE_BYTES), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        # of each row what reading needs, and beside it the unit that it belongs to
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(9)), strict=True))
        for (job_, path, part, category, year), unit in groupby(rows, itemgetter(5, 0, 6, 7, 8)):
            if fs.get_file_info(f"{base}/done/{job_}.json").type != pafs.FileType.NotFound:  # by an attempt before
                continue
            done = _convert(fs, f"{base}/units/{job_}", f"{category}_{year}", contents(r[:5] for r in unit), sections)
            mark = {"job": job_, "path": path, "part": part, "category": category, "year": year, **done}
            _put(fs, f"{base}/done", f"{job_}.json", json.dumps(mark).encode() + b"\n")
            yield pa.RecordBatch.from_pylist([{"job": job_}], pa.schema([("job", pa.string())]))

    # ranges of a digest: a unit is in one of them, and each has about as many members
    dealt = todo.repartitionByRange(n, "job").sortWithinPartitions("job", "path", "member_pos")
    dealt.mapInArrow(run, "job string").write.mode("overwrite").format("noop").save()
    return converted(spark, folder).join(left, "job", "left_semi")


def _one_line(text: str) -> str:
    """Runs of line ends, tabs and blanks become one blank, ends are stripped; a run is halved at a time, so any is done in linear time."""
    for c in "\r\n\t":
        text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text.strip()


def _put(fs: pafs.FileSystem, folder: str, name: str, data: bytes, make: bool = True) -> None:
    """A small file that is there whole or not at all; ``make`` its folder first."""
    if make:
        fs.create_dir(folder, recursive=True)
    temp = f"{folder}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp, compression=None) as out:
        out.write(data)
    fs.move(temp, f"{folder}/{name}")


def _replace(fs: pafs.FileSystem, temp: str, path: str) -> None:
    """``temp`` takes the name of a file that is there. Spark's local writer leaves a checksum beside a file, which does not hold for other bytes: its readers would refuse them. It goes first, as a file without one is read as it is."""
    if isinstance(fs, pafs.LocalFileSystem):
        head, _, name = path.rpartition("/")
        with suppress(FileNotFoundError):  # none was written, or another attempt removed it
            fs.delete_file(f"{head}/.{name}.crc")
    fs.move(temp, path)


def _convert(fs: pafs.FileSystem, folder: str, name: str, articles, sections) -> dict[str, int]:
    """Write a unit's four files; what an attempt before left under other names goes."""
    attempt = f"{folder}/.{uuid.uuid4().hex}"
    fs.create_dir(attempt, recursive=True)
    files = {(kind, s): f"{kind}_list_{name}_{s}.txt" for kind in ("pmcxtract", "pmcid") for s in _SECTIONS}
    counts = {"articles": 0} | dict.fromkeys(_SECTIONS, 0)
    with ExitStack() as stack:
        out = {k: stack.enter_context(fs.open_output_stream(f"{attempt}/{f}", compression=None)) for k, f in files.items()}
        for _, inner, _, data in articles:
            article = inner.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            counts["articles"] += 1
            for s, text in zip(_SECTIONS, sections(data), strict=True):
                text = _one_line(text or "")
                if text:
                    out["pmcxtract", s].write(f"{article} {text}\n".encode())
                    out["pmcid", s].write(f"{article}\n".encode())
                    counts[s] += 1
    for info in fs.get_file_info(pafs.FileSelector(folder)):
        if info.type == pafs.FileType.File:
            fs.delete_file(info.path)
    for f in files.values():
        fs.move(f"{attempt}/{f}", f"{folder}/{f}")
    fs.delete_dir(attempt)
    return counts


def converted(spark: SparkSession, folder: str) -> DataFrame:
    """The units of a folder that are done: (job, path, part, category, year, articles, abstract, body)."""
    if not exists(spark, f"{folder}/done"):
        return spark.createDataFrame([], DONE)
    return spark.read.schema(DONE).json(f"{folder}/done")


def read_converted(spark: SparkSession, folder: str) -> DataFrame:
    """(article_id, text, line, source, category, year) of all units that are done, as :func:`read_lines`; files of others are not seen."""
    lines = read_lines(spark, f"{folder}/units", F.regexp_extract("_metadata.file_path", r"/units/([0-9a-f]{32})/", 1).alias("job"))
    return lines.join(converted(spark, folder).select("job"), "job", "left_semi").drop("job")


def read_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of .txt files, UTF-8 or else Latin-1; empty ones too."""
    files = read_files(spark, path, "*.txt")
    return files.select("path", decode_text(F.col("content")).alias("text"))


def write_files(files: DataFrame, folder: str) -> None:
    """Write (name, content) as files of their own in ``folder``, each named when it is complete; names may hold folders."""
    ship(files.sparkSession)

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        n, made = 0, None
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, _, last = f"{base}/{name}".rpartition("/")
                _put(fs, at, last, content or b"", at != made)
                n, made = n + 1, at
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    files.select("name", "content").mapInArrow(run, "n long").write.mode("overwrite").format("noop").save()


def rewrite_without_blank_lines(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """Drop the blank lines of the text files of a folder, other lines keep their text and end with a line feed: (path, lines, kept).

    A task rewrites a file at a time, a line at a time: to a file beside it, which
    is read again and must hold as many lines as were kept before it takes the
    file's name. So a run that is broken off leaves each file as it was or as it
    shall be, and the next run does the rest. A checksum that Spark wrote beside
    the file goes with the old lines.
    """
    ship(spark)
    files = list_files(spark, folder, glob).where("size > 0")

    def lines(fs, path):
        with fs.open_input_stream(path, compression=None) as f:
            yield from io.TextIOWrapper(io.BufferedReader(f), encoding="utf-8", errors="surrogateescape", newline=None)

    def run(batches):
        for b in batches:
            out = []
            for uri in b.column(0).to_pylist():
                fs, path = located(uri)
                head, _, name = path.rpartition("/")
                temp, n, kept = f"{head}/.{name}.{uuid.uuid4().hex}", 0, 0
                with fs.open_output_stream(temp, compression=None) as to:
                    for line in lines(fs, path):
                        n += 1
                        if line.strip():
                            to.write(line.rstrip("\n").encode("utf-8", "surrogateescape") + b"\n")
                            kept += 1
                if sum(1 for _ in lines(fs, temp)) != kept:
                    raise OSError(f"{uri} was not rewritten whole")
                _replace(fs, temp, path)
                out.append({"path": uri, "lines": n, "kept": kept})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("lines", pa.int64()), ("kept", pa.int64())]))

    n = max(files.count(), 1)
    return materialize(files.select("path").repartition(min(n, 32 * spark.sparkContext.defaultParallelism), "path").mapInArrow(run, "path string, lines long, kept long"), "rewritten")


def read_csvs(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files of a folder with their own headers, all columns text, united by name. Headers are read by tasks, a line of each file."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path")

    def run(batches):
        for b in batches:
            heads = []
            for p in b.column(0).to_pylist():
                with open_uri(p) as f:
                    heads.append(io.TextIOWrapper(io.BufferedReader(f), encoding="utf-8-sig", errors="replace").readline().rstrip("\r\n"))
            yield pa.RecordBatch.from_pydict({"path": b.column(0), "head": pa.array(heads, pa.string())})

    # files with one header are read together; there are as many reads as headers, and Spark skips a header by a file's own first line
    heads = materialize(files.mapInArrow(run, "path string, head string"), "headers")
    names = [r.head for r in heads.select("head").distinct().orderBy("head").collect()]
    if not names:
        raise ValueError(f"no CSV file in {path}")
    if len(names) == 1:
        return spark.read.option("header", True).option("enforceSchema", False).option("pathGlobFilter", "*.csv").csv(path)
    return union_filelists([spark.read.option("header", True).option("enforceSchema", False).csv([r.path for r in heads.where(F.col("head") == h).toLocalIterator()]) for h in names])


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """CSV with a header and no index."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_ids_csv(ids: DataFrame, path: str) -> None:
    """One column PMID."""
    write_csv(ids.select(F.col(ids.columns[0]).alias("PMID")), path)
