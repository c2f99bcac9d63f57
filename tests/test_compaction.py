"""The state in pieces: what a compaction writes, and that reads agree with a plain replay."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from docsnap.plans.layout import Layout
from docsnap.plans.store import DocumentStore
from docsnap.schema import OPS


class Log:
    """A store, and what it should hold."""

    def __init__(self, spark, location):
        self.spark, self.store, self.docs, self.order = spark, DocumentStore(spark, location), {}, {}

    def frame(self, changes):
        rows = self.spark.createDataFrame([(k, v) for k, v in changes.items()], "_id string, text string")
        return rows.select(
            F.lit(1).alias("phase"), F.array("_id").alias("ord"),
            F.when(F.col("text").isNull(), "delete").otherwise("index").alias("op"),
            F.lit("docs").alias("_index"), "_id", F.col("_id").alias("path"),
            F.when(F.col("text").isNotNull(), F.struct(F.col("text").alias("content"), F.struct(F.col("_id").alias("filename")).alias("file"))).alias("doc"),
        ).to(OPS)

    def write(self, changes, run_id=None):
        run_id = run_id or self.store.begin("test")[0]
        self.store.write_ops(run_id, self.frame(changes))
        self.store.commit(run_id, "test", "uploads")
        for key, text in changes.items():
            if self.order.get(key, 0) < run_id:
                self.order[key] = run_id
                self.docs[key] = text
        return run_id

    def check(self):
        found = [(r._id, r.content) for r in self.store.documents().select("_id", "content").collect()]
        assert sorted(found) == sorted((k, v) for k, v in self.docs.items() if v is not None)

    def layout(self):
        return Layout.of(self.store._newest("compact"))

    def written(self, run_id):
        return self.store._state_table(run_id, self.layout().buckets).count()


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, str(tmp_path / "store"))


def keys(*numbers):
    return [f"k{n}" for n in numbers]


def test_a_compaction_writes_what_changed(log):
    log.write({k: "one" for k in keys(*range(1000))})
    first = log.store.compact()
    assert log.written(first) == 1000
    log.write({"k5": "two", "k6": None, "new": "three", "k7": "four"})
    second = log.store.compact()
    assert log.written(second) == 3
    assert {r._id for r in log.store._dead([second]).collect()} == {"k5", "k6", "k7"}
    layout = log.layout()
    assert layout.pieces == (first, second) and sum(layout.rows) == 1003 and sum(layout.dead) == 3
    log.check()
    log.write({"k5": None, "k6": "back", "new": "again"})
    log.check()
    log.store.compact()
    log.check()


def test_buckets_with_many_dead_are_written_anew(log, spark):
    log.write({k: "one" for k in keys(*range(300))})
    first = log.store.compact()
    buckets = log.layout().buckets
    where = {r._id: r.b for r in log.store.state().select("_id", F.pmod(F.hash("_index", "_id"), F.lit(buckets)).alias("b")).collect()}
    target = [k for k, b in where.items() if b == 1]
    log.write({k: "two" for k in target[: len(target) // 2]})
    second = log.store.compact()
    assert log.written(second) == len(target)
    assert log.layout().since == (first, second, first) and sum(log.layout().dead) == 0
    assert sum(log.layout().rows) == 300
    log.check()
    log.write({k: None for k in where if k not in target})
    third = log.store.compact()
    assert log.layout().since == (third, second, third) and log.layout().pieces == (second, third)
    log.check()
    log.store.prune(keep=1)
    log.check()
    assert set(log.store._ids("state")) == {0, second, third}


def test_many_pieces_become_one(log):
    rng = random.Random(1)
    log.write({k: "one" for k in keys(*range(400))})
    first = log.store.compact()
    for step in range(5):
        log.write({k: rng.choice([None, f"step {step}"]) for k in keys(*rng.sample(range(450), 12))})
        last = log.store.compact(most_pieces=3)
        log.check()
        assert len(log.layout().pieces) <= 3
        rows = sum(log.written(p) for p in log.layout().pieces)
        assert sum(log.layout().rows) == rows
        assert rows - sum(log.layout().dead) == sum(v is not None for v in log.docs.values())
    assert log.layout().pieces[0] == first and log.layout().pieces[-1] == last


@pytest.mark.parametrize("seed", [1, 2])
def test_small_states_that_change_much(log, seed):
    """Some buckets are written anew in one piece and others in the next."""
    rng = random.Random(seed)
    for step in range(7):
        log.write({k: rng.choice([None, f"step {step}", f"step {step}"]) for k in keys(*rng.sample(range(14), 4))})
        log.store.compact(most_pieces=4)
        log.check()
        layout = log.layout()
        stored = sum(layout.counted(log.store._state_table(p, layout.buckets), p).count() for p in layout.pieces)
        assert sum(layout.rows) == stored
        assert stored - sum(layout.dead) == sum(v is not None for v in log.docs.values())


def test_another_number_of_buckets_writes_the_whole(log, spark):
    log.write({k: "one" for k in keys(*range(20))})
    log.store.compact()
    log.write({"k1": "two"})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        run = log.store.compact()
        assert log.layout().pieces == (run,) and log.layout().buckets == 5 and log.written(run) == 20
        log.check()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_runs_that_are_committed_late(log, spark):
    """An open run is committed after a compaction: newer documents and deletions stand."""
    log.write({"a": "one", "b": "one", "c": "one"})
    late = log.store.begin("late")[0]
    log.write({"a": "two", "b": None, "d": "two"})
    log.store.compact()
    log.write({"e": "three"})
    log.write({"a": "late", "b": "late", "c": "late", "d": "late", "f": "late"}, run_id=late)
    assert log.docs == {"a": "two", "b": None, "c": "late", "d": "two", "e": "three", "f": "late"}
    log.check()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = log.store.documents()._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    # The scan of whole documents has no exchange above it.
    at = next(i for i, line in enumerate(lines) if "docsnap_state" in line and "content" in line)
    depth, above = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for line in reversed(lines[:at]):
        if (own := len(line) - len(line.lstrip(" :+-"))) < depth:
            above.append(line)
            depth = own
    assert above and not [line for line in above if "Exchange" in line]
    log.store.compact()
    log.check()
    log.store.prune(keep=1)
    log.check()


def test_deletions_are_remembered_while_a_run_is_open(log):
    late = log.store.begin("late")[0]
    log.write({"a": "one"})
    log.write({"a": None})
    log.store.compact()
    log.store.compact()
    assert [(r._id, r.of_run) for r in log.store._tombs(log.layout().run_id).collect()] == [("a", 3)]
    log.write({"a": "late"}, run_id=late)
    log.check()
    assert log.docs["a"] is None
    log.store.compact()
    log.store.compact()
    assert log.store._tombs(log.layout().run_id).count() == 0
    log.check()


def test_writers_that_meet_share_no_id(log, spark, monkeypatch):
    """Both write their claim before either looks: neither takes the id."""
    other = DocumentStore(spark, log.store.location)
    looks, met = log.store._writers, []

    def late_look(run_id):
        if not met:
            met.append(other._claim(run_id))
        return looks(run_id)

    monkeypatch.setattr(log.store, "_writers", late_look)
    mine = log.store.begin("x")[0]
    assert met == [False] and mine > 1
    assert other.begin("y")[0] > mine


def test_creating_need_not_fail_where_a_file_exists(log, spark):
    """Storage on which to create is to overwrite: names of claims are all different."""
    found, stores = [], [DocumentStore(spark, log.store.location) for _ in range(6)]

    def claim(store):
        for _ in range(5):
            found.append(store.begin("x")[0])

    threads = [threading.Thread(target=claim, args=(s,)) for s in stores]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(found) == len(set(found)) == 30
