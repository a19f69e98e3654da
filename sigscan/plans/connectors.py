"""Queries over files, XML and a paged service: fixtures are written to the shared folder from the driver's tables, then read back."""

from __future__ import annotations

import contextlib
import gzip
import io
import tarfile
import uuid
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import PythonException, SparkRuntimeException as SparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigscan.functions.sql import register
from sigscan.functions.text import clean_text, decode_text, page_text
from sigscan.operators import integrity, routing
from sigscan.plans.carriers import ARTICLES, CORE_JOURNALS, FILELIST, MEMBERS, derive
from sigscan.plans.catalogue import _BIN, _CITE, _DECIDED, _J, _LIST, _TRIM, _TYPES_OF, _Y, _YEAR_TEXT, ORACLES, PVALUES, _buckets_sql, decided, labels, pvalue_histogram, query, re2
from sigscan.session import materialize, shared_path, ship, spread, table
from sigscan.sources import archives, corpus
from sigscan.sources.tarstore import TarStore
from sigscan.sources.xmltext import article_sections, publication_types, section_texts
from sigscan.streaming.router import Router

#: Characters that XML 1.0 does not allow.
_FORBIDDEN = r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]"
#: The same by those that it allows, which Java tests in half the time.
_NOT_XML = r"[^\x09\x0a\x0d\x20-\ufffd\x{10000}-\x{10ffff}]"
_ALLOWED = f"regexp_replace(coalesce(text, ''), {re2(_FORBIDDEN)}, '', 'g')"
_PLAIN = f"replace(replace({_ALLOWED}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"  # line ends as XML readers see them


def _xml_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular XML around whole texts, so that SQL can check it too; malformed for every 10th document."""
    safe = F.regexp_replace(F.coalesce("text", F.lit("")), _NOT_XML, "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    end = F.when(F.col("doc_id") % 10 == 9, "</broken>").otherwise("</article>")
    xml = F.concat(F.lit("<article><front><abstract><p> First "), F.col("doc_id").cast("string"), F.lit("</p></abstract></front><Body><sec>"), safe, F.lit("</sec></Body>"), end)
    return table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml"))


@query(
    f"SELECT doc_id, CASE WHEN doc_id % 10 <> 9 THEN 'First ' || CAST(doc_id AS VARCHAR) END AS abstract, "
    f"CASE WHEN doc_id % 10 <> 9 THEN nullif({_TRIM(_PLAIN)}, '') END AS body FROM documents"
)
def xml_abstract_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xml_docs(spark, sf_dir).select("doc_id", article_sections("xml").alias("s")).select("doc_id", "s.abstract", "s.body")


_B = "[ \\t\\r\\n]"
_PAGE = f"regexp_replace(coalesce(html, ''), '(?is)<!--.*?(?:-->|\\z)|<script[ \\t\\r\\n>].*?(?:</script{_B}*>|\\z)|<style[ \\t\\r\\n>].*?(?:</style{_B}*>|\\z)', ' ', 'g')"
_PAGE = f"regexp_replace(regexp_replace({_PAGE}, '(?is)^.*?<body(?:{_B}[^>]*)?>', ''), '(?is)</body{_B}*>.*$', '')"


@query(f"SELECT page_id, {_TRIM(f'regexp_replace(regexp_replace({_PAGE}, ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + _B + '+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS body FROM pages")
def pages_body_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages are mostly not XML: their text is taken without a parser."""
    return table(spark, sf_dir, "pages").select("page_id", page_text(F.col("html")).alias("body"))


#: The folder that an archive lies in.
_SOURCE = "([^/]+)/[^/]+$"
_WITH_TEXT = MEMBERS.replace("SELECT ", "SELECT text, ", 1)


@query(f"SELECT src_tar, inner_path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, sha256(coalesce(text, '')) AS digest FROM ({_WITH_TEXT})")
def tar_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of archives that are written first, those of a source archive in a folder of its name, whole texts in them."""
    paths = _write_archives(_with_text(spark, sf_dir), shared_path(spark, "archives"))
    return archives.members(paths).select(F.regexp_extract("src_tar", _SOURCE, 1).alias("src_tar"), "inner_path", F.octet_length("content").cast("long").alias("n"), F.sha2("content", 256).alias("digest"))


def _with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, _WITH_TEXT).select("src_tar", "inner_path", "member_pos", F.coalesce("text", F.lit("")).cast("binary").alias("content"))


#: Bytes of members of a compressed archive that is written.
ARCHIVE_BYTES = 32 << 20


def _write_archives(df: DataFrame, folder: str) -> DataFrame:
    """Gzip-compressed archives ``<src_tar>/<part>.tar.gz`` of each src_tar, members in order: (path). As a compressed archive is read by one task, a source has an archive for each ``ARCHIVE_BYTES``. An archive gets its name when it is complete."""
    ship(df.sparkSession)
    sizes = materialize(df.groupBy("src_tar").agg(F.ceil(F.sum(F.octet_length("content") + 1024) / F.lit(ARCHIVE_BYTES)).alias("parts")), "sizes")
    sizes = sizes.withColumn("before", F.sum("parts").over(Window.orderBy("src_tar")) - F.col("parts"))  # a row a source
    parted = df.join(sizes, "src_tar").withColumn("part", F.pmod(F.xxhash64("inner_path"), F.col("parts")).cast("int"))
    n = sizes.agg(F.sum("parts")).first()[0] or 1

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        now, out, tar, names = None, None, None, []

        def close():
            if tar:
                tar.close()
                out.close()
                fs.move(temp, f"{base}/{now}")
                names.append(f"{folder}/{now}")

        for b in batches:
            for src, part, inner, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                name = f"{src}/{part:05d}.tar.gz"
                if name != now:
                    close()
                    fs.create_dir(f"{base}/{src}", recursive=True)
                    now, temp = name, f"{base}/.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temp, compression=None)
                    tar = tarfile.open(fileobj=out, mode="w|gz")
                info = tarfile.TarInfo(inner)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        close()
        if names:
            yield pa.RecordBatch.from_pydict({"path": pa.array(names)})

    dealt = parted.repartitionById(int(n), (F.col("before") + F.col("part")).cast("int")).sortWithinPartitions("src_tar", "part", "member_pos")
    return materialize(dealt.select("src_tar", "part", "inner_path", "content").mapInArrow(run, "path string"), "archives")


def _damaged_archives(batches):
    """A compressed archive around each text: sound, with a broken checksum, or of something that is no tar."""
    for b in batches:
        names, contents = [], []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            body, data = io.BytesIO(), (text or "").encode()
            with tarfile.open(fileobj=body, mode="w") as tar:
                info = tarfile.TarInfo(f"d/PMC{doc_id}.xml")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
            kind = doc_id % 3
            packed = gzip.compress(body.getvalue() if kind < 2 else b"not a tar" * 500 + data, 1)
            names.append(f"{doc_id}.tar.gz")
            contents.append(packed[:-8] + b"\0" * 8 if kind == 1 else packed)
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "content": pa.array(contents, pa.binary())})


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'gzip_failed' ELSE 'tar_failed' END AS status FROM documents")
def archive_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each document, whole texts in them: sound ones, broken checksums, and ones that hold no tar."""
    ship(spark)
    folder = shared_path(spark, "checked")
    corpus.write_files(table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_damaged_archives, "name string, content binary").withColumn("name", F.concat_ws("/", _group(F.split_part("name", F.lit("."), F.lit(1)).cast("long")), "name")), folder)
    found = archives.check_archives(archives.list_archives(spark, folder))
    return found.select(F.regexp_extract("path", r"([^/]+)\.tar\.gz$", 1).cast("long").alias("doc_id"), "status")


def _group(doc_id: Column) -> Column:
    """The folder of a document's file: a thousand documents each, so that no folder holds all files."""
    return F.concat(F.lit("k"), F.floor(doc_id / F.lit(1000)).cast("string"))


_LATIN = r"[^\x00-\xff]"


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE chr(233) || ' ' || regexp_replace(coalesce(text, ''), {re2(_LATIN)}, '?', 'g') END AS text FROM documents")
def decode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, half of them as Latin-1 that is no UTF-8."""
    docs, text = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    latin = F.encode(F.concat(F.lit("é "), F.regexp_replace(text, _LATIN, "?")), "ISO-8859-1")
    return docs.select("doc_id", decode_text(F.when(F.col("doc_id") % 2 == 0, text.cast("binary")).otherwise(latin)).alias("text"))


_LINE = _TRIM("regexp_replace(line, '[ \\t\\r\\n]+', ' ', 'g')")


@query(f"SELECT 'PMC' || CAST(doc_id AS VARCHAR) AS article_id, 'review' AS category, year, sha256({_LINE}) AS digest FROM ({ARTICLES})")
def line_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles written as line corpora with category and year in their names, then scanned."""
    folder = shared_path(spark, "lines")
    corpus.write_corpus(derive(spark, sf_dir, ARTICLES).select(F.lit("review").alias("category"), "year", F.lit("body").alias("section"), clean_text(F.col("line")).alias("line")), folder)
    return corpus.read_lines(spark, folder).select("article_id", "category", "year", F.sha2("line", 256).alias("digest"))


@query(f"WITH {_DECIDED} SELECT pmcid, src_tar, reason FROM decided")
def incremental_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing in three batches against the ledger, one repeated: the final state equals one batch's."""
    known = labels(spark, sf_dir)
    router = Router(spark, shared_path(spark, "router"), known)
    members = derive(spark, sf_dir, MEMBERS)
    for k, name in enumerate(("a_comm.tar", "b_noncomm.tar", "c_other.tar")):
        router.process(members.where(F.col("src_tar") == name), k)
    router.process(members, 3)  # all seen: changes nothing
    kept = router.table("manifest").select("pmcid", "src_tar", F.lit(routing.ACCEPT).alias("reason"))
    return kept.unionByName(router.table("skipped").select(F.nullif("pmcid", F.lit("")).alias("pmcid"), "src_tar", "reason"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 <> 9 THEN 'Type ' || coalesce(lang, '') || ' ; T' || CAST(doc_id % 3 AS VARCHAR) END AS types FROM documents")
def record_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication types out of records; a malformed one has none."""
    end = F.when(F.col("doc_id") % 10 == 9, "</x>").otherwise("</r>")
    xml = F.concat(F.lit("<r><PublicationType>Type "), F.coalesce("lang", F.lit("")), F.lit("</PublicationType><PublicationType/><a><PublicationType>T"), (F.col("doc_id") % 3).cast("string"), F.lit("</PublicationType></a>"), end)
    return table(spark, sf_dir, "documents").select("doc_id", publication_types(xml).alias("types"))


# ---- files


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), lang, NULL FROM documents WHERE doc_id % 2 = 1")
def csv_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files with two headers in one folder, written and united by name."""
    folder, docs = shared_path(spark, "csv"), table(spark, sf_dir, "documents")
    corpus.write_csv(docs.where("doc_id % 2 = 0").select("doc_id", "lang", "source"), folder)
    corpus.write_csv(docs.where("doc_id % 2 = 1").select("lang", "doc_id"), folder, mode="append")
    return corpus.read_csvs(spark, folder).select("doc_id", "lang", "source")


@query("SELECT CAST(doc_id AS VARCHAR) AS PMID FROM documents")
def id_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "ids")
    corpus.write_ids_csv(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id")), folder)
    return corpus.read_csvs(spark, folder)


@query(f"WITH {_DECIDED} SELECT bucket, {_YEAR_TEXT.replace('unknown', 'unknown-year')} AS year, r.pmcid || '.xml' AS inner_path, CAST(octet_length(encode(coalesce(d.text, ''))) AS BIGINT) AS n FROM (SELECT unnest(buckets) AS bucket, year, pmcid, member_pos FROM decided WHERE reason = 'accept') r JOIN documents d ON d.doc_id = r.member_pos")
def bucket_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted articles appended in three runs to the tar archives of their buckets and years, whole texts in them, compacted and read back."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("member_pos"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    copied = routing.copies(decided(spark, sf_dir)).select("bucket", "year", "pmcid", "member_pos").join(texts, "member_pos")
    store = TarStore(spark, shared_path(spark, "buckets"))
    for k in range(3):  # three runs add to the same buckets; then each bucket and year is one archive
        store.append(copied.where(F.pmod(F.col("member_pos"), F.lit(3)) == k).drop("member_pos"), f"run-{k}")
    store.compact("compacted")
    parts = store.parts()
    found = archives.members(parts, by_path=True).withColumnRenamed("src_tar", "path").join(parts, "path")
    return found.select("bucket", "year", "inner_path", F.octet_length("content").cast("long").alias("n"))


_SECTIONS = f"SELECT 'PMC' || CAST(doc_id AS VARCHAR) AS article_id, year, CASE WHEN doc_id % 10 <> 9 THEN 'First ' || CAST(doc_id AS VARCHAR) END AS abstract, CASE WHEN doc_id % 10 <> 9 THEN {_TRIM('regexp_replace(' + _PLAIN + ', ' + chr(39) + '[ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} END AS body FROM (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(1990 + doc_id % 36 AS INTEGER) END AS year FROM documents)"


class BreaksOff:
    """An extraction that fails at articles whose number of bytes leaves ``rest`` by 5: what a killed run looks like to the units after it."""

    def __init__(self, rest: int):
        self.rest = rest

    def __call__(self, data: bytes):
        if len(data) % 5 == self.rest:
            raise OSError("broken off")
        return section_texts(data)


@query(f"WITH s AS ({_SECTIONS}) SELECT 'pmc_abstract' AS source, year, sha256(article_id || ' ' || abstract) AS digest FROM s WHERE abstract <> '' UNION ALL SELECT 'pmc_body', year, sha256(article_id || ' ' || body) FROM s WHERE body <> ''")
def archive_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as XML in a tar archive a year, converted in two runs that are broken off and one that ends: each line is there once."""
    folder = shared_path(spark, "converted")
    year = F.when(F.col("doc_id") % 7 != 0, 1990 + F.col("doc_id") % 36).cast("int")
    copied = _xml_docs(spark, sf_dir).select(F.lit("review").alias("bucket"), year.alias("year"), F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("pmcid"), F.col("xml").cast("binary").alias("content"))
    written = materialize(archives.export_tars(copied, f"{folder}/tars"), "written")
    jobs = written.select("path", F.lit("review").alias("category"), F.regexp_extract("path", "/([0-9]{4})/[^/]+$", 1).try_cast("int").alias("year"))
    for rest in (0, 1):
        with contextlib.suppress(PythonException, SparkException):
            corpus.convert_archives(jobs, folder, 4 << 20, BreaksOff(rest))
    corpus.convert_archives(jobs, folder, 4 << 20)
    return corpus.read_converted(spark, folder).select("source", "year", F.sha2("line", 256).alias("digest"))


@query(f"SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: {_TRIM('x')} <> ''), lambda x: x || chr(10)), '') AS text FROM documents")
def blank_lines_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return integrity.without_blank_lines(docs).withColumnRenamed("path", "doc_id")


@query(f"WITH {_DECIDED} SELECT pmcid, src_tar, reason FROM decided")
def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing from a stream of files, in two runs with checkpoints of their own over one ledger."""
    folder = shared_path(spark, "stream")
    members = derive(spark, sf_dir, MEMBERS)
    router = Router(spark, f"{folder}/state", labels(spark, sf_dir))
    source = spark.readStream.schema(members.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1000)
    for k, name in enumerate(("a_comm.tar", "b_noncomm.tar", "c_other.tar")):
        members.where(F.col("src_tar") == name).write.parquet(f"{folder}/in/{name}")
        router.stream(source.parquet(f"{folder}/in"), f"{folder}/checkpoint-{k // 2}")
    kept = router.table("manifest").select("pmcid", "src_tar", F.lit(routing.ACCEPT).alias("reason"))
    return kept.unionByName(router.table("skipped").select(F.nullif("pmcid", F.lit("")).alias("pmcid"), "src_tar", "reason"))


#: Spark's readers drop a byte order mark that begins a file, so files have escapes for it and for the character that begins an escape.
_ESCAPES = (("\x1a", "\x1a0"), ("\ufeff", "\x1a1"))


def _without_bom(c: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _ESCAPES, c)


def _with_bom(c: Column) -> Column:
    plain = reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(_ESCAPES), c)
    return F.when(F.contains(c, F.lit("\x1a")), plain).otherwise(c)


@query(f"SELECT coalesce(lang, 'none') AS lang, sha256(line) AS digest FROM (SELECT lang, unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n')) AS line FROM documents) WHERE {_TRIM('line')} <> ''")
def folder_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in files by language, rewritten in place without blank lines."""
    folder = shared_path(spark, "texts")
    # a folder's name begins with a letter, as Spark takes "01" for a number and "" for null
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("l"), F.coalesce("lang", F.lit("none"))).alias("lang"), _without_bom(F.coalesce("text", F.lit(""))).alias("value"))
    docs.write.partitionBy("lang").text(folder)
    corpus.rewrite_without_blank_lines(spark, folder)
    lines = spark.read.text(folder).select(F.substring("lang", 2, F.length("lang")).alias("lang"), F.sha2(_with_bom(F.col("value")), 256).alias("digest"))
    return lines


@query("SELECT coalesce(lang, 'none') || '.' || CAST(doc_id AS VARCHAR) || '.txt' AS name, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE chr(233) || ' ' || regexp_replace(coalesce(text, ''), " + re2(_LATIN) + ", '?', 'g') END AS text FROM documents")
def text_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a text file of its own, half of them Latin-1, then the folder scanned."""
    folder = shared_path(spark, "texts")
    text = F.coalesce("text", F.lit(""))
    latin = F.encode(F.concat(F.lit("é "), F.regexp_replace(text, _LATIN, "?")), "ISO-8859-1")
    name = F.concat(F.coalesce("lang", F.lit("none")), F.lit("."), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = table(spark, sf_dir, "documents").select(_group(F.col("doc_id")).alias("group"), name.alias("name"), F.when(F.col("doc_id") % 2 == 0, text.cast("binary")).otherwise(latin).alias("content"))
    corpus.write_files(files.withColumn("name", F.concat_ws("/", "group", "name")), folder)
    return corpus.read_text_folder(spark, folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "text")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'rct' ELSE 'review' END AS field, CAST(2000 + doc_id % 5 AS VARCHAR) AS year, CASE WHEN doc_id % 3 = 0 THEN 'tgz' WHEN doc_id % 3 = 1 THEN 'tar.gz' ELSE 'tar' END AS kind, count(*) AS n FROM documents GROUP BY ALL")
def archive_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion jobs found by the names of archives below a folder; other files, one a document, are not jobs."""
    folder = shared_path(spark, "jobs")
    kind = F.element_at(F.array(F.lit("tgz"), F.lit("tar.gz"), F.lit("tar")), (F.col("doc_id") % 3 + 1).cast("int"))
    field = F.when(F.col("doc_id") % 2 == 0, "rct").otherwise("review")
    place = F.concat(_group(F.col("doc_id")), F.lit("/d"), F.col("doc_id").cast("string"), F.lit("/"), field, F.lit("/"), (2000 + F.col("doc_id") % 5).cast("string"), F.lit("."))
    docs = table(spark, sf_dir, "documents")
    archive = docs.select(F.concat(place, kind).alias("name"), F.col("text").cast("binary").alias("content"))
    corpus.write_files(archive.unionByName(docs.select(F.concat(place, F.lit("txt")).alias("name"), F.lit(b"x").alias("content"))), folder)
    jobs = archives.list_archives(spark, folder)
    return jobs.groupBy("field", "year", F.regexp_extract("path", r"\.(tgz|tar\.gz|tar)$", 1).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT bin, CAST(n AS VARCHAR) AS n FROM (" + ORACLES["pvalue_histogram"].replace("SELECT bin, count(*) AS n FROM pv", "SELECT CAST(bin AS VARCHAR) AS bin, count(*) AS n FROM pv") + ")")
def histogram_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as a tab-separated file with a header, read back as text."""
    folder = shared_path(spark, "report")
    corpus.write_csv(pvalue_histogram(spark, sf_dir), folder, sep="\t")
    lines = spark.read.text(folder).where("value not like 'bin%'").select(F.split("value", "\t").alias("v"))
    return lines.select(F.col("v")[0].alias("bin"), F.col("v")[1].alias("n"))


# ---- from SQL


@query(f"WITH {PVALUES} SELECT '0.' || lpad(CAST({_BIN} AS VARCHAR), 3, '0') AS bin, op, count(*) AS n FROM pv GROUP BY ALL")
def sql_pvalue_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return spark.sql("SELECT pvalue_bin(v.p) AS bin, v.op, count(*) AS n FROM (SELECT explode(pv) AS v FROM (SELECT pvalues(line) AS pv FROM {arts})) GROUP BY ALL", arts=spread(derive(spark, sf_dir, ARTICLES)))


@query(f"WITH {_LIST}, {_CITE}, t AS (SELECT doc_id, {_J} AS journal, {_Y} AS year FROM c WHERE ok), b AS (SELECT doc_id, {_TYPES_OF('publication_type')} AS types FROM f) SELECT doc_id, journal, year, array_to_string({_buckets_sql('types', 'journal')}, ';') AS categories FROM t JOIN b USING (doc_id)")
def sql_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations and categories of a file list in one statement."""
    register(spark)
    core = ", ".join(f"'{j.strip().lower()}'" for j in CORE_JOURNALS)
    rows = f"SELECT doc_id, citation_journal(citation) AS journal, citation_year(citation) AS year, publication_type FROM {{files}} WHERE citation_valid(citation)"
    return spark.sql(f"SELECT doc_id, journal, year, array_join(article_categories(publication_type, lower(trim(journal)) IN ({core})), ';') AS categories FROM ({rows})", files=derive(spark, sf_dir, FILELIST))


@query(f"SELECT src_tar, inner_path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM ({_WITH_TEXT})")
def sql_tar_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of whole texts listed by a table function, an archive a call."""
    register(spark)
    paths = _write_archives(_with_text(spark, sf_dir), shared_path(spark, "archives"))
    return spark.sql(f"SELECT regexp_extract(path, '{_SOURCE}', 1) AS src_tar, inner_path, size FROM {{paths}}, LATERAL tar_index(path)", paths=paths.repartition(max(1, paths.count()), "path"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST((row_number() OVER (PARTITION BY doc_id % 64 ORDER BY doc_id) - 1) // 20 AS BIGINT) AS chunk FROM documents")
def sql_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of 20 ids within each of 64 lists."""
    register(spark)
    return spark.sql("SELECT id, chunk FROM request_chunks(20, TABLE(SELECT doc_id, doc_id % 64 AS list FROM {docs}) PARTITION BY list ORDER BY doc_id)", docs=table(spark, sf_dir, "documents"))
