"""The router's stream: state instead of the ledger, kills between state and output, cost by the batch."""

import pytest
from pyspark.sql import functions as F

from sigscan.operators import routing
from sigscan.streaming.router import Router

COLUMNS = "src_tar string, inner_path string, member_pos long"


def known(spark):
    rows = [(f"{k}", "2010", "1" if k % 3 else "0") for k in range(400)]
    return routing.load_labels(spark.createDataFrame(rows, "pmcid string, year string, all_article string"))


def members(spark, batch):
    """40 members a batch: ids come again in later batches, some members too, and some within a batch."""
    rows = [(f"{batch}.tar", f"d/PMC{(batch * 20 + k) % 400}.xml", k) for k in range(40)]
    rows += [(f"{batch}.tar", "d/PMC7.xml", 50), (f"{batch}.tar", "e/PMC7.xml", 51), (f"{batch}.tar", f"note{batch}.xml", 52)]
    rows += [("0.tar", "d/PMC1.xml", 1)] * 2
    return spark.createDataFrame(rows, COLUMNS)


def state(router):
    kept = [(r.pmcid, r.src_tar, "accept") for r in router.table("manifest").collect()]
    return sorted(kept + [(r.pmcid, r.src_tar, r.inner_path, r.reason) for r in router.table("skipped").collect()])


def run(spark, folder, batches, router=None):
    router = router or Router(spark, f"{folder}/state", known(spark))
    for b in batches:
        members(spark, b).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/{b}")
        source = spark.readStream.schema(COLUMNS).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        router.stream(source, f"{folder}/checkpoint")
    return router


def test_a_stream_remembers_by_state_alone(spark, tmp_path, monkeypatch):
    router = run(spark, tmp_path, range(3))
    first = {}
    for b in range(3):
        for r in sorted(members(spark, b).collect()):
            first.setdefault(routing_id(r.inner_path), b)
    kept = {r.pmcid: int(r.src_tar.split(".")[0]) for r in router.table("manifest").collect()}
    assert kept == {i: b for i, b in first.items() if i and int(i[3:]) % 3}
    assert router.ledger().select("src_tar", "inner_path").distinct().count() == router.ledger().count()
    # with one run no batch reads the ledger
    monkeypatch.setattr(Router, "process", None)
    reads = []
    keep = Router.ledger
    monkeypatch.setattr(Router, "ledger", lambda self: reads.append(1) or keep(self))
    run(spark, tmp_path, [3], router)
    assert len(reads) == 1  # once before the stream, to see that there is no older run


def routing_id(path):
    name = path.rsplit("/", 1)[-1].upper()
    return name[:-4] if name.startswith("PMC") else None


def test_a_kill_between_state_and_output_changes_nothing(spark, tmp_path):
    whole = state(run(spark, tmp_path / "whole", range(3)))

    class Killed(Router):
        left = 3

        def _write(self, decided, batch, run_):
            Killed.left -= 1
            if Killed.left == 1:  # the second batch: all of its outputs but the ledger are there
                decided = decided.cache()
                for name in ("manifest", "skipped"):
                    getattr(routing, name)(decided).write.mode("overwrite").parquet(f"{self.path}/{name}/run={run_}/batch={batch}")
                raise OSError("killed")
            super()._write(decided, batch, run_)

    folder = tmp_path / "killed"
    router = Killed(spark, f"{folder}/state", known(spark))
    run(spark, folder, [0], router)
    with pytest.raises(Exception, match="killed"):
        run(spark, folder, [1], router)
    again = run(spark, folder, [1, 2])
    assert [x for x in state(again)] == whole
    assert again.ledger().select("run").distinct().count() == 1


def test_streams_equal_single_batches(spark, tmp_path):
    streamed = run(spark, tmp_path, range(2))
    single = Router(spark, f"{tmp_path}/single", known(spark))
    for b in range(2):
        single.process(members(spark, b).dropDuplicates(["src_tar", "inner_path"]), b)
    assert state(streamed) == state(single)
    assert streamed.table("skipped").where(F.col("reason") == routing.UNRECOGNIZED).count() == 2


def test_state_is_sparks_own_and_a_hot_id_is_judged_once(spark, tmp_path):
    """No Python for each id; an id with most of the members, in two batches, and archives without a name."""
    router = Router(spark, f"{tmp_path}/state", known(spark))
    rows = lambda k: [(f"{k}.tar", f"d{n}/PMC8.xml", n) for n in range(3000)] + [(None, "d/PMC10.xml", 0), (None, "e/PMC10.xml", None)]
    for k in (1, 0):
        spark.createDataFrame(rows(k), COLUMNS).repartition(3).write.parquet(f"{tmp_path}/in/{k}")
        source = spark.readStream.schema(COLUMNS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        assert "Pandas" not in router.judged(source)._jdf.queryExecution().analyzed().toString()
        router.stream(source, f"{tmp_path}/checkpoint")
    got = router.table("manifest").select("pmcid", "src_tar").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("PMC8", "1.tar"), ("PMC10", None)], key=str)
    left = router.table("skipped").groupBy("pmcid", "src_tar", "reason").count().collect()
    assert sorted(map(tuple, left), key=str) == sorted([("PMC8", "1.tar", routing.DUPLICATE, 2999), ("PMC8", "0.tar", routing.DUPLICATE, 3000), ("PMC10", None, routing.DUPLICATE, 1)], key=str)
    assert router.table("skipped").where("inner_path = 'd/PMC10.xml'").count() == 1  # (null position) comes first
