"""Comparison by digests next to the comparison of all files."""

import random

import pytest

from docsnap.operators.diff import change_feed
from docsnap.operators.digests import DigestSnapshot, directory_digests, part_digests
from docsnap.session import WorkTables


def frame(spark, files):
    return spark.createDataFrame([(p, float(t), len(p)) for p, t in files.items()], "path string, mtime double, length long").repartition(3)


def tree(rng, folders=60, files=8):
    return {f"/r/d{rng.randrange(9)}/e{d}/f{n}": rng.randrange(100) for d in range(folders) for n in range(rng.randrange(files))}


def rows(df):
    return sorted(map(tuple, df.select("path", "status", "mtime", "previous_mtime", "length").collect()), key=str)


@pytest.mark.parametrize("changes", [0, 1, 5, 200])
def test_same_feed_as_of_all_files(spark, tmp_path, changes):
    rng = random.Random(changes)
    before = tree(rng)
    now = dict(before)
    for path in rng.sample(sorted(now), changes if changes < len(now) else len(now) // 2):
        match rng.randrange(4):
            case 0:
                del now[path]
            case 1:
                now[path] += 1
            case 2:
                now[path + "x"] = 5
            case 3:
                now[path.replace("/r/", "/new/")] = now.pop(path)
    snapshot = DigestSnapshot(spark, str(tmp_path / "snapshot"), parts=16)
    snapshot.write(frame(spark, before))
    with WorkTables(spark) as work:
        feed = snapshot.change_feed(frame(spark, now), work)
        assert rows(feed) == rows(change_feed(frame(spark, now), frame(spark, before)))


def test_unchanged_parts_are_not_read(spark, tmp_path):
    before = {f"/r/d{d}/f{n}": 1 for d in range(200) for n in range(3)}
    snapshot = DigestSnapshot(spark, str(tmp_path / "snapshot"), parts=32)
    snapshot.write(frame(spark, before))
    with WorkTables(spark) as work:
        feed = snapshot.change_feed(frame(spark, before | {"/r/d7/f1": 2}), work)
        plan = feed._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r)[:2] for r in feed.filter("status <> 'unchanged'").collect()] == [("/r/d7/f1", "modified")]
        assert feed.count() == 600
    scan = next(line for line in plan.split("\n") if "FileScan" in line and "path#" in line and "part#" in line)
    assert "part#" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_swap_of_times_shows(spark):
    one = directory_digests(frame(spark, {"/r/a": 1, "/r/b": 2, "/s/a": 3}))
    two = directory_digests(frame(spark, {"/r/a": 2, "/r/b": 1, "/s/a": 3}))
    a, b = ({r.directory: (r.files, r.one, r.two) for r in x.collect()} for x in (one, two))
    assert a["/s"] == b["/s"] and a["/r"] != b["/r"] and a["/r"][1:] != b["/r"][1:]
    assert part_digests(one).agg({"files": "sum"}).first()[0] == 3


def test_empty_sides(spark, tmp_path):
    empty, some = frame(spark, {"/r/a": 1}).limit(0), frame(spark, {"/r/a": 1})
    for k, (before, now) in enumerate([(empty, some), (some, empty), (empty, empty)]):
        snapshot = DigestSnapshot(spark, str(tmp_path / str(k)))
        snapshot.write(before)
        with WorkTables(spark) as work:
            assert rows(snapshot.change_feed(now, work)) == rows(change_feed(now, before))
