"""Folders listed and files read by tasks, against Spark's own reader."""

from pyspark.sql import functions as F

from sigscan.sources import archives, corpus, listing


def tree(top):
    """300 folders of one file, odd names, hidden files, empty folders."""
    for k in range(300):
        (top / f"d{k % 7}/e{k}/x y").mkdir(parents=True)
        (top / f"d{k % 7}/e{k}/x y/20{k % 10}.{('tgz', 'TAR', 'txt')[k % 3]}").write_bytes(b"%d" % k * (k % 5))
    for name in (".hidden.tar", "_hidden.tar", "_a=b.tar", "a%20b#c é.tar", "d1/_tmp/x.tar", "d1/.x/x.tar", "y.tar._COPYING_"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(b"1")
    (top / "empty/deeper").mkdir(parents=True)


def test_tasks_list_what_spark_lists(spark, tmp_path, monkeypatch):
    tree(tmp_path)
    want = sorted(tuple(r) for r in listing.by_spark(spark, f"{tmp_path}", "*.t*").select("path", "length").collect())
    for limit in (1, 3, listing.WALK):  # what a task has not walked is handed over
        monkeypatch.setattr(listing, "WALK", limit)
        for folder in (f"{tmp_path}", f"file://{tmp_path}/"):
            got = sorted(tuple(r) for r in listing.list_files(spark, folder, "*.t*").collect())
            assert [r for r in got if r[1]] == want and len(got) == len(set(got)) == len(want) + 40  # empty files too
    assert sorted(tuple(r) for r in listing.list_files(spark, f"{tmp_path}/d[0-9]", "*.txt").collect()) == [r for r in want if r[0].endswith(".txt")]
    (tmp_path / "none").mkdir()
    assert listing.list_files(spark, f"{tmp_path}/none").count() == 0
    assert [r.size for r in listing.list_files(spark, f"{tmp_path}/_a=b.tar").collect()] == [1]


def test_names_of_archives_stay_off_the_driver(spark, tmp_path):
    tree(tmp_path)
    jobs = archives.list_archives(spark, f"{tmp_path}")
    assert jobs.where(F.col("field") == "x y").count() == 200  # empty ones too
    assert not [f for f in jobs.inputFiles() if f.lower().endswith((".tar", ".tgz", ".txt"))]


def test_text_files_are_read_by_few_tasks(spark, tmp_path):
    """Spark's reader takes a task for every few small files, keeps their names on the driver and leaves out empty ones."""
    tree(tmp_path)
    (tmp_path / "latin.txt").write_bytes("caf\xe9".encode("latin-1"))
    read = corpus.read_text_folder(spark, f"{tmp_path}")
    got = {r.path.removeprefix("file:"): r.text for r in read.collect()}
    assert got == {str(p): p.read_bytes().decode("latin-1") for p in tmp_path.rglob("*.txt")} and "" in got.values()
    assert read.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert not [f for f in read.inputFiles() if f.endswith(".txt")]
