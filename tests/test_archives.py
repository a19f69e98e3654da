"""Tar archives: index and ranges against the sequential reader."""

import gzip
import io
import random
import re
import sys
import tarfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import compare
from sigscan.plans import connectors
from sigscan.plans.catalogue import ORACLES
from sigscan.plans.catalogue import QUERIES
from sigscan.sources import archives, corpus
from sigscan.sources.tarstore import TarStore
from sigscan.sources.xmltext import section_texts


def pack(path, names, mode="w", size=lambda k: 300 + k % 50):
    with tarfile.open(path, mode) as tar:
        for k, name in enumerate(names):
            info = tarfile.TarInfo(name)
            info.size = size(k)
            tar.addfile(info, io.BytesIO((b"%06d" % k) * (info.size // 6 + 1)))


def sequential(path):
    with tarfile.open(path) as tar:
        return [(m.name, pos, tar.extractfile(m).read()) for pos, m in enumerate(tar) if m.isfile() and m.name.lower().endswith(".xml")]


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    """10,000 members, some with long names (extra headers), folders and other files between them."""
    names = [("d" * 120 + "/" if k % 100 == 0 else "") + (f"PMC{k}.XML" if k % 7 else f"note{k}.txt") for k in range(10_000)]
    pack(tmp_path / "big.tar", names)
    listed = archives.list_archives(spark, f"{tmp_path}")
    index = archives.index_archives(listed)
    read = archives.read_members(index, range_bytes=1 << 19)
    got = sorted((r.inner_path, r.member_pos, bytes(r.content)) for r in read.collect())
    assert got == sorted(sequential(tmp_path / "big.tar"))
    busy = read.groupBy(F.spark_partition_id()).count().collect()
    assert len(busy) >= 8
    # rows of the index are all that is needed to read some members
    some = archives.read_members(index.where("member_pos % 1000 = 1")).collect()
    assert sorted(r.member_pos for r in some) == [k for k in range(1, 10_000, 1000) if k % 7]


@pytest.mark.parametrize("mode", ["w", "w:gz", "w:bz2", "w:xz"])
def test_kinds_of_archives(spark, tmp_path, mode):
    name = "x.tar" + mode[1:].replace(":", ".")
    pack(tmp_path / name, [f"PMC{k}.xml" for k in range(50)], mode, size=lambda k: 20_000 * (k % 3))
    read = archives.members(archives.list_archives(spark, f"{tmp_path}"))
    assert sorted((r.inner_path, r.member_pos, bytes(r.content)) for r in read.collect()) == sorted(sequential(tmp_path / name))
    assert {(r.src_tar, r.readable, r.content) for r in archives.members(archives.list_archives(spark, f"{tmp_path}"), content=False, by_path=False).collect()} == {(name, True, None)}


def test_archives_of_one_name_are_told_apart(spark, tmp_path):
    for folder in ("comm", "noncomm"):
        (tmp_path / folder).mkdir()
        pack(tmp_path / folder / "x.tar", ["PMC1.xml"])
    got = archives.members(archives.list_archives(spark, f"{tmp_path}"), content=False)
    assert got.select("src_tar").distinct().count() == 2


def test_empty_and_odd_archives(spark, tmp_path):
    pack(tmp_path / "none.tar", [])
    with tarfile.open(tmp_path / "odd.tar", "w") as tar:
        for kind, name in ((tarfile.DIRTYPE, "d.xml"), (tarfile.SYMTYPE, "l.xml"), (tarfile.REGTYPE, "PMC1.xml")):
            info = tarfile.TarInfo(name)
            info.type, info.linkname = kind, "PMC1.xml" if kind == tarfile.SYMTYPE else ""
            tar.addfile(info)
    got = archives.members(archives.list_archives(spark, f"{tmp_path}")).collect()
    assert [(r.inner_path, r.member_pos, bytes(r.content)) for r in got] == [("PMC1.xml", 2, b"")]
    assert archives.members(archives.list_archives(spark, f"{tmp_path}").where("false")).count() == 0


@pytest.mark.parametrize("name", ["tar_members", "sql_tar_index"])
def test_a_source_of_many_bytes_is_many_archives(spark, sf, monkeypatch, name):
    """A compressed archive is one task's, so its bytes are bounded."""
    written, keep = [], connectors._write_archives
    monkeypatch.setattr(connectors, "ARCHIVE_BYTES", 1 << 15)
    monkeypatch.setattr(connectors, "_write_archives", lambda *a: written.append(keep(*a)) or written[-1])
    compare(spark, sf, QUERIES[name], ORACLES[name])
    assert written[0].count() > 10
    index = archives.index_archives(written[0])
    assert index.groupBy("path").agg(F.sum("size").alias("n"), F.count("*").alias("k")).where(f"n > 4 * {1 << 15} and k > 1").count() == 0


def test_checks_of_archives(spark, tmp_path):
    """Each verdict from one reading, a failing checksum before a failing structure."""
    pack(tmp_path / "good.tar", [f"PMC{k}.xml" for k in range(500)])
    good = (tmp_path / "good.tar").read_bytes()
    packed = gzip.compress(good)
    kinds = {"ok": (packed, gzip.compress(b"") + packed, gzip.compress(good) + b"\0" * 64), "tar_failed": (gzip.compress(good[:5000]), gzip.compress(b"nonsense" * 999), gzip.compress(b""), b""), "gzip_failed": (packed[:-8] + b"\0" * 8, packed[: len(packed) // 2], b"nonsense" * 99, good, gzip.compress(b"nonsense" * 999)[:-4], packed + b"more")}
    for status, contents in kinds.items():
        (tmp_path / "z" / status).mkdir(parents=True)
        for k, data in enumerate(contents):
            (tmp_path / f"z/{status}/{k}.tar.gz").write_bytes(data)
    got = archives.check_archives(archives.list_archives(spark, f"{tmp_path}/z")).collect()
    assert len(got) == 13 and all(r.path.split("/")[-2] == r.status for r in got), got


def test_files_of_checked_archives_lie_in_folders(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(connectors, "shared_path", lambda *a: f"file://{tmp_path}/checked")
    compare(spark, sf, connectors.archive_check, ORACLES["archive_check"])
    assert all(p.is_dir() for p in (tmp_path / "checked").iterdir())


class Breaks:
    """An extraction that fails at one article."""

    def __init__(self, name):
        self.name = name

    def __call__(self, data):
        if self.name in data:
            raise OSError("broken off")
        return section_texts(data)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors can't import tests


def test_a_broken_run_keeps_what_is_finished(spark, tmp_path):
    (tmp_path / "in/review").mkdir(parents=True)
    for year in range(2000, 2006):
        with tarfile.open(tmp_path / f"in/review/{year}.tar", "w") as tar:
            for k in range(60):
                data = f"<a><abstract>abstract {year}-{k}</abstract><body>{'body' if k % 3 else ''}\n text</body>{'x' * 2000}</a>".encode() if k != 7 else b"<a>"
                info = tarfile.TarInfo(f"d/PMC{year}{k:02}.xml")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    jobs = archives.list_archives(spark, f"{tmp_path}/in").select("path", F.col("field").alias("category"), F.col("year").cast("int").alias("year"))
    out, unit = f"file://{tmp_path}/out", 1 << 16
    units = archives.ranges(archives.index_archives(jobs.select("path")), unit).select("path", "part").distinct().count()
    assert units > 6  # an archive is many units
    with pytest.raises(Exception, match="broken off"):
        corpus.convert_archives(jobs.withColumn("category", F.lit("other")), out, unit, Breaks(b"abstract 2003-50<"))
    kept = {r.job for r in corpus.converted(spark, out).collect()}
    assert len(kept) < units
    # files of a unit without its mark, of a category that has changed since
    corpus.convert_archives(jobs.where("year = 2003"), out, unit)
    again = {r.job for r in corpus.converted(spark, out).where("year = '2003'").collect()} - kept
    assert again
    rest = {r.job for r in corpus.convert_archives(jobs, out, unit).collect()}
    assert not rest & (kept | again) and len(kept | again | rest) == units
    assert corpus.convert_archives(jobs, out, unit).count() == 0
    lines = corpus.read_converted(spark, out).collect()
    want = [f"PMC{y}{k:02} abstract {y}-{k}" for y in range(2000, 2006) for k in range(60) if k != 7] + [f"PMC{y}{k:02} {'body ' if k % 3 else ''}text" for y in range(2000, 2006) for k in range(60) if k != 7]
    assert sorted(r.line for r in lines) == sorted(want)
    done = corpus.converted(spark, out).agg(F.sum("articles").alias("a"), F.sum("abstract").alias("b"), F.sum("body").alias("c")).first()
    assert tuple(done) == (360, 354, 354)
    assert corpus.read_ids(spark, f"{tmp_path}/out/units").where("category = 'review'").count() > 0


class Noted:
    """An extraction that leaves a file for each task and counts articles in it."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, data):
        from pyspark import TaskContext

        with open(f"{self.folder}/{TaskContext.get().taskAttemptId()}", "a") as f:
            f.write("x")
        return section_texts(data)


def test_units_share_tasks_and_one_with_its_mark_is_passed_over(spark, tmp_path, monkeypatch):
    """A task for each unit cost more than small units themselves."""
    rows = [("review", 2000 + k % 2, f"PMC{k}", f"<a><body>text {k}</body>{'x' * 2000}</a>".encode()) for k in range(1000)]
    jobs = archives.export_tars(spark.createDataFrame(rows, "bucket string, year int, pmcid string, content binary"), f"file://{tmp_path}/in").select("path", F.lit("review").alias("category"), F.regexp_extract("path", "/([0-9]{4})/", 1).cast("int").alias("year"))
    jobs = spark.createDataFrame(jobs.collect(), "path string, category string, year int")
    for name in ("first", "second"):
        (tmp_path / name).mkdir()
    articles = lambda name: {f.name: len(f.read_text()) for f in (tmp_path / name).iterdir()}
    out, unit, tasks = f"file://{tmp_path}/out", 1 << 15, 4 * spark.sparkContext.defaultParallelism
    assert corpus.convert_archives(jobs, out, unit, Noted(f"{tmp_path}/first")).count() > 3 * tasks
    first = articles("first")
    assert sum(first.values()) == 1000 and len(first) <= tasks and max(first.values()) < 4 * 1000 / tasks
    # as an attempt before has left them: marked since the run began, but for three
    marks = sorted((tmp_path / "out/done").glob("*.json"))
    for m in marks[:3]:
        m.unlink()
    real, calls = corpus.converted, []
    monkeypatch.setattr(corpus, "converted", lambda s, f: calls.append(f) or (real(s, f) if len(calls) > 1 else s.createDataFrame([], corpus.DONE)))
    assert corpus.convert_archives(jobs, out, unit, Noted(f"{tmp_path}/second")).count() == len(marks)
    assert 0 < sum(articles("second").values()) < 100
    assert sorted(r.line for r in corpus.read_converted(spark, out).collect()) == sorted(f"PMC{k} text {k}" for k in range(1000))


def test_an_archive_is_a_task_of_its_own(spark, tmp_path):
    """However few partitions the session shuffles to; the largest come first."""
    rows = [(f"b{b}", None if b % 3 else 2000 + b, f"PMC{k}", b"x" * k) for b in range(20) for k in range(10 + 4 * b)]
    written = archives.export_tars(spark.createDataFrame(rows, "bucket string, year int, pmcid string, content binary"), f"file://{tmp_path}/tars", max_members=50)
    got = written.withColumn("task", F.spark_partition_id()).orderBy("task").collect()
    assert len({r.task for r in got}) == len(got) > 20 and "/b19/" in got[0].path
    assert sum(r.members for r in got) == len(rows)
    read = archives.members(spark.createDataFrame([(r.path,) for r in got], "path string"))
    place = F.regexp_extract("src_tar", "/(b[0-9]+)/([^/]+)/[^/]+$", 1), F.regexp_extract("src_tar", "/(b[0-9]+)/([^/]+)/[^/]+$", 2)
    assert sorted((r[0], r[1], r.inner_path, bytes(r.content)) for r in read.select(*place, "inner_path", "content").collect()) == sorted((b, str(y) if y else "unknown-year", f"{p}.xml", c) for b, y, p, c in rows)


def test_texts_on_one_line():
    rng = random.Random(5)
    for _ in range(20_000):
        s = "".join(rng.choices(" \t\r\nab\x0b\u3000", k=rng.randrange(14)))
        assert corpus._one_line(s) == re.sub("[\r\n\t ]+", " ", s).strip()


def test_characters_that_xml_allows(spark):
    every = "".join(chr(k) for k in [*range(0xD800), *range(0xE000, 0x10000), 0x10000, 0x1F600, 0x10FFFF])
    a, b = spark.createDataFrame([(every,)], "t string").select(*(F.regexp_replace("t", p, "") for p in (connectors._FORBIDDEN, connectors._NOT_XML))).first()
    assert a == b and len(every) - len(a) == 31


def stored(spark, store):
    parts = store.parts()
    found = archives.members(parts).withColumnRenamed("src_tar", "path").join(parts, "path")
    return sorted((r.bucket, r.year, r.inner_path, bytes(r.content)) for r in found.collect())


def test_runs_append_and_a_kill_leaves_the_state_before(spark, tmp_path, monkeypatch):
    store = TarStore(spark, f"file://{tmp_path}/store")
    rows = [(b, 2010 if k % 2 else None, f"PMC{k}", f"<a>{k}</a>".encode() * (k + 1)) for k in range(30) for b in ("all", "review")[: 1 + k % 2]]
    df = spark.createDataFrame(rows, "bucket string, year int, pmcid string, content binary")
    want = lambda n: sorted((b, str(y) if y else "unknown-year", f"{p}.xml", c) for b, y, p, c in rows if int(p[3:]) < n)
    assert stored(spark, store) == []
    store.append(df.where("substr(pmcid, 4) < 10"), "one", max_members=3)
    first = want(10)
    assert stored(spark, store) == first
    store.append(df, "one")  # committed: not done again
    assert stored(spark, store) == first
    second = df.where("substr(pmcid, 4) >= 10")
    with monkeypatch.context() as m:  # killed between the archives and the commit
        m.setattr(TarStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            store.append(second, "two")
        assert stored(spark, store) == first
    store.append(second, "two")
    assert stored(spark, store) == want(30)
    with monkeypatch.context() as m:
        m.setattr(TarStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            store.compact("all")
        assert stored(spark, store) == want(30) and store.runs() == ["one", "two"]
    store.compact("all")
    assert stored(spark, store) == want(30) and store.runs() == ["all"] and store.parts().count() == 3
    store.vacuum()
    assert stored(spark, store) == want(30) and sorted(p.name for p in (tmp_path / "store/parts").iterdir()) == ["all"]
    store.append(df.where("pmcid = 'PMC3'").withColumn("bucket", F.lit("meta")), "three")
    store.compact("again", max_members=5)  # archives above the bound stay as they are
    assert len(stored(spark, store)) == len(rows) + 2 and store.parts().where("members > 100").count() == 0
