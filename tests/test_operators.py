"""Metadata, routing, sources, streaming on small fixtures."""

import gzip
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import ROOT
from sigscan.functions.categories import query_text
from sigscan.operators import integrity, metadata, routing, trend
from sigscan.session import ship
from sigscan.sources import archives, corpus, literature
from sigscan.sources.xmltext import section_texts
from sigscan.streaming.router import Router


def labels(spark):
    rows = [(0, "11", "2010.0", "1", "0", "yes", "T", "0", "0"), (1, "pmc12", "n/a", "1", "0", "0", "0", "0", "0"), (2, "PMC13", "2011", "0", "0", "0", "0", "0", "0"), (3, "PMC11", "2012", "1.0", "1", "0", "0", "0", "0"), (4, " ", "2000", "1", "0", "0", "0", "0", "0")]
    return routing.load_labels(spark.createDataFrame(rows, "pos int, PMCID string, Year string, all_article string, meta_analysis string, review string, clinical_useful_journal string, randomized_controlled_trial string, clinical_trial string"), "pos")


MEMBERS = [("a.tar", "d/PMC11.xml", 0), ("a.tar", "d/pmc12.XML", 1), ("a.tar", "d/PMC13.xml", 2), ("a.tar", "d/PMC99.xml", 3), ("b.tar", "d/PMC99.xml", 0), ("b.tar", "d/PMC11.xml", 1), ("b.tar", "d/notes.xml", 2)]


def test_labels(spark):
    got = {r.pmcid: (r.year, r.buckets) for r in labels(spark).collect()}
    assert got == {"PMC11": (2012, ["meta-analysis"]), "PMC12": (None, ["all-articles"]), "PMC13": (2011, [])}
    with pytest.raises(ValueError):
        routing.load_labels(spark.createDataFrame([("1",)], "id string"))


def test_decisions(spark):
    df = spark.createDataFrame(MEMBERS, "src_tar string, inner_path string, member_pos long")
    got = {(r.src_tar, r.inner_path): r.reason for r in routing.decide(df, labels(spark)).collect()}
    with pytest.raises(ValueError):
        routing.union_collections(common=df)
    assert [got[m[:2]] for m in MEMBERS] == ["accept", "accept", "no-category-flags", "metadata-missing", "duplicate-pmcid", "duplicate-pmcid", "non-xml or unrecognized filename"]
    m = {r.pmcid: r for r in routing.manifest(routing.decide(df, labels(spark))).collect()}
    assert m["PMC12"].year == "unknown" and m["PMC12"].output_tar_paths == "pmc/all-articles/unknown-year.tar"


def test_router_replays_and_streams(spark, tmp_path):
    df = spark.createDataFrame(MEMBERS, "src_tar string, inner_path string, member_pos long")
    df.where("src_tar = 'a.tar'").write.parquet(f"{tmp_path}/in/a")
    router = Router(spark, f"{tmp_path}/state", labels(spark))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    router.stream(stream, f"{tmp_path}/checkpoint")
    df.where("src_tar = 'b.tar'").write.parquet(f"{tmp_path}/in/b")
    router.stream(stream, f"{tmp_path}/checkpoint")
    state = lambda: sorted((r.pmcid, r.src_tar, r.reason) for r in router.table("skipped").collect())
    first = state()
    assert ("PMC99", "b.tar", "duplicate-pmcid") in first and ("PMC11", "b.tar", "duplicate-pmcid") in first
    assert sorted(r.pmcid for r in router.table("manifest").collect()) == ["PMC11", "PMC12"]
    router.process(df.where("src_tar = 'b.tar'"), 1)  # a batch that is repeated leaves the same state
    assert state() == first


def test_a_new_run_keeps_the_older_ones(spark, tmp_path):
    df = spark.createDataFrame([(*m, b"x" * 10) for m in MEMBERS], "src_tar string, inner_path string, member_pos long, content binary")
    router = Router(spark, f"{tmp_path}/state", labels(spark))
    assert router.ledger().count() == 0
    for k, name in enumerate(("a", "b")):
        df.where(f"src_tar = '{name}.tar'").write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        router.stream(stream, f"{tmp_path}/checkpoint{k}")  # batches count from 0 again
    assert sorted(r.pmcid for r in router.table("manifest").collect()) == ["PMC11", "PMC12"]
    assert sorted((r.src_tar, r.reason) for r in router.table("skipped").collect() if r.pmcid == "PMC99") == [("a.tar", "metadata-missing"), ("b.tar", "duplicate-pmcid")]
    assert router.ledger().count() == len(MEMBERS) and router.ledger().select("run").distinct().count() == 2
    # a batch that was broken off before its ledger is not part of the state
    df.limit(1).select("src_tar", "inner_path").write.parquet(f"{tmp_path}/state/manifest/run=rz/batch=0")
    assert sorted(r.pmcid for r in router.table("manifest").collect()) == ["PMC11", "PMC12"]


def test_chunks_of_wide_rows_lose_none(spark):
    df = spark.range(200_000).select(F.col("id"), *[F.concat(F.lit(f"column {k} "), F.md5(F.col("id").cast("string"))).alias(f"c{k}") for k in range(6)]).repartition(37)
    got = integrity.chunks(df, "id", 1000)
    assert got.count() == 200_000
    sizes = got.groupBy("chunk").agg(F.count("*").alias("n"), F.min("id").alias("least")).collect()
    assert {r.chunk: (r.n, r.least) for r in sizes} == {k: (1000, 1000 * k) for k in range(200)}


def test_package_is_shipped_whole(spark, tmp_path):
    """A bare interpreter in another folder imports the archive that executors get, without the repository."""
    ship(spark)
    archive = spark.sparkContext._sigscan_shipped
    assert any(archive.rsplit("/", 1)[-1] in f for f in spark.sparkContext.listFiles)
    code = f"import sys; sys.path.insert(0, {archive!r}); from sigscan.sources import xmltext as x; from sigscan.llm import tokens; print(x.__file__, x.section_texts('<a><abstract>x</abstract></a>'))"
    code = code if (ROOT / "sigscan/llm").exists() else code.replace("from sigscan.llm import tokens; ", "")
    out = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == f"{archive}/sigscan/sources/xmltext.py ('x', None)", out.stderr[-2000:]


def test_rows_that_repeat_are_accepted_once(spark):
    rows = [("a.tar", "d/PMC11.xml", 0)] * 3 + [("a.tar", "e/pmc11.xml", 0), ("a.tar", "d/PMC12.xml", 1), ("b.tar", "d/PMC12.xml", 0), ("a.tar", "x.xml", 0), ("a.tar", "x.xml", 0)]
    got = sorted((r.inner_path, r.src_tar, r.reason) for r in routing.decide(spark.createDataFrame(rows, "src_tar string, inner_path string, member_pos long").repartition(4), labels(spark)).collect())
    assert got == sorted([("d/PMC11.xml", "a.tar", "accept")] + [("d/PMC11.xml", "a.tar", "duplicate-pmcid")] * 2 + [("e/pmc11.xml", "a.tar", "duplicate-pmcid"), ("d/PMC12.xml", "a.tar", "accept"), ("d/PMC12.xml", "b.tar", "duplicate-pmcid")] + [("x.xml", "a.tar", "non-xml or unrecognized filename")] * 2)


def test_archives(spark, tmp_path):
    rows = [("all-articles", 2010, f"PMC{k}", f"<a>{k}</a>".encode()) for k in range(5)] + [("review", None, "PMC1", b"<a/>")]
    done = archives.export_tars(spark.createDataFrame(rows, "bucket string, year int, pmcid string, content binary"), f"file://{tmp_path}/tars", max_members=3).collect()
    assert sum(r.members for r in done) == 6 and len(done) >= 2
    listed = archives.list_archives(spark, f"{tmp_path}/tars")
    got = sorted((r.inner_path, bytes(r.content)) for r in archives.members(listed).collect())
    assert got == sorted((f"{p}.xml", c) for _, _, p, c in rows)
    assert {r.content for r in archives.members(listed, content=False).collect()} == {None}
    (tmp_path / "z").mkdir()
    (tmp_path / "z/x.tar.gz").write_bytes(gzip.compress(b"nonsense" * 100))
    assert [r.status for r in archives.check_archives(archives.list_archives(spark, f"{tmp_path}/z")).collect()] == ["tar_failed"]


def test_xml():
    assert section_texts("<a><abstract>x <b>y</b>z</abstract><ABSTRACT> 2 </ABSTRACT><body> </body></a>") == ("x yz\n2", None)
    assert section_texts("<a><abstract>x</a>") == (None, None)
    assert section_texts(None) == (None, None)
    assert section_texts(b"<!DOCTYPE a SYSTEM 'http://x/y.dtd'><a><Body>1 &lt; 2</Body></a>") == (None, "1 < 2")


def test_enrichment_policies(spark):
    df = spark.createDataFrame([(0, "7", ""), (1, "7", None), (2, "0", ""), (3, "8", "Review")], "pos int, PMID string, PublicationType string")
    fetch = lambda ids, n: ids.where("PMID = '7'").select("PMID", F.lit("T").alias("fetched")) if n == 1 else ids.where("false").select("PMID", F.lit("").alias("fetched"))
    out, left = metadata.enrich_types(df, fetch)
    assert {r.pos: r.PublicationType for r in out.collect()} == {0: "T", 1: "T", 2: "", 3: "Review"} and left.count() == 0
    out, _ = metadata.enrich_types(df, fetch, dup_policy="last", order="pos")
    assert {r.pos: r.PublicationType for r in out.collect()} == {0: "", 1: "T", 2: "", 3: "Review"}


def test_citations(spark):
    texts = ["J Test. 2010 Jan 5; 1(2):3-4", "Ann. Test Res. 1999; 7:1", "J Test. 2010 ;9", "J NoYear.;5", ";", "2010;", "J. A. 2001 Spring-Summer;", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, c string")
    got = {r.k: (r.journal, r.year) for r in metadata.parse_citations(df, "c").collect()}
    assert got == {0: ("J Test", "2010"), 1: ("Ann. Test Res", "1999"), 2: (None, None), 3: ("J NoYear", None), 4: (None, None), 5: (None, "2010"), 6: ("J. A", "2001"), 7: (None, None), 8: (None, None)}
    assert sorted(r.k for r in metadata.split_citations(df, "c")[1].collect()) == [2, 7, 8]


def test_text_sources(spark, tmp_path):
    (tmp_path / "pmxtract_list_rct_1999.txt").write_text("900002\tBACKGROUND a.\tRESULTS p = 0.01\n\n \n900003\tx\r\n", encoding="utf-8")
    (tmp_path / "pmid_list_rct_1999.txt").write_text("900002\n900003\n")
    (tmp_path / "note.txt").write_bytes("caf\xe9".encode("latin-1"))
    got = {r.article_id: r for r in corpus.read_lines(spark, str(tmp_path)).collect()}
    assert set(got) == {"900002", "900003"} and got["900002"].text == "BACKGROUND a.\tRESULTS p = 0.01"
    assert (got["900002"].source, got["900002"].category, got["900002"].year) == ("pubmed_abstract", "rct", 1999)
    assert corpus.read_ids(spark, str(tmp_path)).count() == 2
    assert "café" in [r.text for r in corpus.read_text_folder(spark, str(tmp_path)).collect()]
    arts = spark.createDataFrame([("PMC1", "review", 2001, " a\r\nb ", None), ("PMC2", "review", None, "", "c")], "article_id string, category string, year int, abstract string, body string")
    corpus.write_lines(arts, f"{tmp_path}/out")
    out = spark.read.text(f"{tmp_path}/out/texts")
    assert sorted((r.value, r.section, str(r.year)) for r in out.collect()) == [("PMC1 a b", "abstract", "2001"), ("PMC2 c", "body", "unknown-year")]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("PMID,x\n1,2\n")
    (tmp_path / "b.csv").write_text("x,PMID,y\n3,4,5\n")
    assert sorted((r.PMID, r.x, r.y) for r in corpus.read_csvs(spark, str(tmp_path)).collect()) == [("1", "2", None), ("4", "3", "5")]
    corpus.write_ids_csv(spark.createDataFrame([("9",)], "id string"), f"{tmp_path}/ids")
    assert spark.read.option("header", True).csv(f"{tmp_path}/ids").columns == ["PMID"]


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors can't import tests


class Flaky:
    """A service whose second page fails."""

    def count(self, db, query):
        return 5

    def ids(self, db, query, start, size):
        if start == 2:
            raise OSError("page lost")
        return [str(k) for k in range(start, min(5, start + size))]

    def fetch(self, db, ids):
        return {i: f"<article><abstract><p>t{i}</p></abstract></article>" for i in ids}


def test_service(spark):
    assert literature.count_ids(Flaky(), "q") == 5
    assert sorted(r.article_id for r in literature.all_ids(spark, Flaky(), "q", page=2).collect()) == ["0", "1", "4"]
    pages = literature.search_pages(spark, Flaky(), "q", page=2).where("error is not null").collect()
    assert [(r.page, r.article_id, r.error) for r in pages] == [(1, None, "page lost")]

    class Down(Flaky):
        def fetch(self, db, ids):
            raise OSError("down")

    lost = literature.fetch_records(spark.createDataFrame([("1",), ("2",)], "id string").coalesce(1), Down(), batch=5).collect()
    assert sorted((r.article_id, r.xml, r.error) for r in lost) == [("1", None, "down"), ("2", None, "down")]
    got = literature.abstracts(spark.createDataFrame([("1",), ("2",)], "id string"), Flaky(), cap=1).collect()
    assert [(r.article_id, r.text) for r in got] == [("1", "t1")]
    assert literature.journal_ids(spark, Flaky(), ["B", "A", "A"], first=1, page=2).select("journal").distinct().collect()[0].journal == "A"
    assert literature.journal_ids(spark, Flaky(), []).count() == 0
    with pytest.raises(ValueError):
        query_text("nothing", 2000)
    assert query_text("all", 2001) == '"2001"[PDAT] AND hasabstract AND medline[sb]'


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "article_id string, category string, year int, pv array<struct<p:double,op:string>>")
    grid = trend.dense_grid(trend.trend(trend.with_least(none)))
    assert grid.count() == 6 * 36 and grid.agg(F.sum("total")).first()[0] == 0
    assert integrity.missing_ids(none, none).count() == 0


def test_each_id_is_asked_once_a_pass(spark, tmp_path):
    """Both outputs are read several times; a run that is broken off in its second pass is resumed by one that asks for what is left."""
    df = spark.createDataFrame([(k, str(100 + k % 40), "") for k in range(90)], "pos int, PMID string, PublicationType string")
    asked = {n: spark.sparkContext.accumulator(0) for n in (200, 20, 1)}

    def fetch(ids, n, fail=False):
        def run(frames):
            for f in frames:
                for _ in f["PMID"]:
                    asked[n].add(1)
                if fail and len(f):
                    raise OSError("service down")
                yield f[f["PMID"].astype(int) % {200: 3, 20: 6, 1: 30}[n] != 0].assign(fetched=f"T{n}")

        return ids.coalesce(1).mapInPandas(run, "PMID string, fetched string")

    with pytest.raises(Exception, match="service down"):
        metadata.enrich_types(df, lambda ids, n: fetch(ids, n, n == 20), folder=f"{tmp_path}/asked")
    before = [asked[n].value for n in (200, 20, 1)]  # a task that fails may count or not
    assert before[0] == 40
    out, left = metadata.enrich_types(df, fetch, folder=f"{tmp_path}/asked")
    for _ in range(3):
        out.collect()
        left.collect()
    assert [asked[n].value - b for n, b in zip((200, 20, 1), before, strict=True)] == [0, 13, 7]
    assert sorted(r.PMID for r in left.collect()) == ["120"]
    assert {r.PMID: r.PublicationType for r in out.collect()} == {str(k): "" if k == 120 else "T200" if k % 3 else "T20" if k % 6 else "T1" for k in range(100, 140)}
    metadata.enrich_types(df, fetch, folder=f"{tmp_path}/asked")
    assert [asked[n].value - b for n, b in zip((200, 20, 1), before, strict=True)] == [0, 13, 7]


def test_folders_are_rewritten(spark, tmp_path, monkeypatch):
    (tmp_path / "t/a").mkdir(parents=True)
    files = {"a/x.txt": b"a\r\n \t\nb\xff\n\n\xe3\x80\x80\nc", "y.txt": b"\n\n", "z.txt": b"", "long.txt": b"line\n\n" * 300_000, "keep.csv": b"a\n\n"}
    for name, data in files.items():
        (tmp_path / "t" / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: (r.lines, r.kept) for r in corpus.rewrite_without_blank_lines(spark, f"{tmp_path}/t").collect()}
    assert got == {"x.txt": (6, 3), "y.txt": (2, 0), "long.txt": (600_000, 300_000)}
    want = {"a/x.txt": b"a\nb\xff\nc\n", "y.txt": b"", "z.txt": b"", "long.txt": b"line\n" * 300_000, "keep.csv": b"a\n\n"}
    read = lambda: {str(p.relative_to(tmp_path / "t")): p.read_bytes() for p in (tmp_path / "t").rglob("*") if p.is_file() and p.suffix != ".crc"}
    assert read() == want
    corpus.rewrite_without_blank_lines(spark, f"{tmp_path}/t")
    assert read() == want


def test_rewritten_files_are_read_by_spark(spark, tmp_path):
    folder = f"{tmp_path}/t"
    texts = [("a\n\nb\r\n \t\nc", 0), ("\n", 1), ("", 0), ("kept\nas it is", 1)] * 3
    spark.createDataFrame(texts, "value string, k int").repartition(3).write.partitionBy("k").text(folder)
    assert any((tmp_path / "t").rglob("*.txt.crc"))
    for _ in range(2):
        corpus.rewrite_without_blank_lines(spark, folder)
        assert sorted(r.value for r in spark.read.text(folder).collect()) == sorted(["a", "b", "c", "kept", "as it is"] * 3)


def test_ordered_distinct_lines_as_files(spark, tmp_path):
    lines = [(k % 3, k, f"l{k * k % 50}" if k % 9 else "") for k in range(300)]
    df = spark.createDataFrame(lines, "file int, k int, line string").repartition(7)
    integrity.write_distinct_lines(df, ["file", "k"], "line", f"{tmp_path}/out")
    want = list(dict.fromkeys(t for _, _, t in sorted(lines)))
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.suffix == ".txt")
    assert [t for f in files for t in f.read_text().splitlines()] == want
    assert [r.line for r in integrity.read_ordered_lines(spark, f"{tmp_path}/out").orderBy("pos").collect()] == want
