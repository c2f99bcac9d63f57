"""Counts kept up by changes next to a recount, and the operations of a store as a stream."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docsnap.operators.diff import change_feed
from docsnap.plans.counts import KeptCounts, index_deltas, path_deltas
from docsnap.plans.store import DocumentStore
from docsnap.schema import OPS
from docsnap.streaming.operations import OperationsReader, OperationsSource


def frame(spark, files):
    return spark.createDataFrame([(p, float(t)) for p, t in files.items()], "path string, mtime double")


def recount(files):
    nodes = Counter({"docs": len(files)}) if files else Counter()
    for path in files:
        parts = path.split("/")
        nodes.update("/".join(parts[:k]) for k in range(2, len(parts) + 1))
    return dict(nodes)


@pytest.mark.parametrize("fold_at", [0, 2, 4])
def test_like_a_recount(spark, tmp_path, fold_at):
    rng = random.Random(fold_at)
    kept, files = KeptCounts(spark, str(tmp_path / "counts")), {}
    assert kept.counts().collect() == []
    for run in range(1, 6):
        before = dict(files)
        for _ in range(30):
            path = f"/r/{rng.randrange(3)}/{rng.randrange(4)}/f{rng.randrange(9)}"
            files.pop(path, None) if rng.random() < 0.3 else files.update({path: rng.randrange(3)})
        files = files if run < 5 else {}
        feed = change_feed(frame(spark, files) if files else frame(spark, {"/x": 1}).limit(0), frame(spark, before) if before else frame(spark, {"/x": 1}).limit(0))
        for _ in range(1 + run % 2):  # a run that is done again
            kept.add(run, path_deltas(feed).unionByName(index_deltas(feed, "docs")))
        if run == fold_at:
            kept.fold()
        assert {r.key: r["count"] for r in kept.counts().collect()} == recount(files)


def test_unchanged_rows_and_unfinished_runs_do_not_count(spark, tmp_path):
    kept = KeptCounts(spark, str(tmp_path / "counts"))
    feed = spark.createDataFrame([("/r/a", "new"), ("/r/b", "unchanged"), ("/r/c", "modified"), ("/s/d", "deleted")], "path string, status string")
    assert {(r.key, r["count"]) for r in path_deltas(feed).collect()} == {("/r", 1), ("/r/a", 1), ("/s", -1), ("/s/d", -1)}
    assert "IN (new,deleted)" in path_deltas(feed)._jdf.queryExecution().toString()
    kept.add(1, path_deltas(feed.filter("status = 'new'")))
    kept.add(2, path_deltas(feed))
    os.remove(f"{kept.location}/deltas/run_id=2/_SUCCESS")
    assert {(r.key, r["count"]) for r in kept.counts().collect()} == {("/r", 1), ("/r/a", 1)}


def write(store, run_id, *keys):
    rows = store.spark.createDataFrame([(k,) for k in keys], "_id string").select(
        F.lit(1).alias("phase"), F.array("_id").alias("ord"), F.lit("index").alias("op"), F.lit("docs").alias("_index"), "_id",
        F.col("_id").alias("path"), F.struct(F.struct(F.lit("2024-05-06 07:08:09").cast("timestamp").alias("last_modified")).alias("file")).alias("doc"),
    )
    store.write_ops(run_id, rows.to(OPS))


def test_offsets_name_committed_runs(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    reader = OperationsReader(store.location)

    def between(start, end):
        return sorted(b["_id"][k].as_py() for p in reader.partitions(start, end) for b in reader.read(p) for k in range(b.num_rows))

    zero = reader.initialOffset()
    assert reader.latestOffset() == zero
    one, two, three = (store.begin("x")[0] for _ in range(3))
    for run, key in ((one, "a"), (two, "b"), (three, "c")):
        write(store, run, key, key + key)
    store.commit(two, "x", "uploads")
    first = reader.latestOffset()
    assert between(zero, first) == ["b", "bb"]
    store.compact()
    store.commit(one, "x", "uploads")  # late
    os.remove(f"{store.location}/commits/run_id={one}/_SUCCESS")
    assert between(first, reader.latestOffset()) == []  # not to its end yet
    store.commit(one, "x", "uploads")
    second = reader.latestOffset()
    assert between(first, second) == ["a", "aa"]
    store.commit(three, "x", "uploads")
    last = reader.latestOffset()
    assert between(second, last) == ["c", "cc"] and between(zero, last) == ["a", "aa", "b", "bb", "c", "cc"]
    assert between(last, last) == []


def test_rows_arrive_as_they_were_written(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    run = store.begin("x")[0]
    write(store, run, "a", "b")
    store.commit(run, "x", "uploads")
    spark.dataSource.register(OperationsSource)
    rows = spark.readStream.format("operations").option("location", store.location).load()
    query = rows.writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.table("followed")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, store.ops().select(*found.columns).collect()))
