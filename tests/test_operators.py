"""Operators against brute force, with hot groups."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsnap.functions.paths import walk_order
from docsnap.operators import batches, diff, events, facets, filters, state, terms, uploads
from docsnap.operators.extract import PythonExtractor, text_extractor
from docsnap.operators.ops import upload_ops
from docsnap.operators.position import with_position
from docsnap.options import CrawlOptions
from docsnap.plans.requests import apply_deletes, apply_uploads
from docsnap.plans.store import DocumentStore
from docsnap.schema import EVENTS, STRINGS, struct


def brute_batches(sizes, bulk_size, byte_size):
    number = rows = total = 0
    out = []
    for size in sizes:
        out.append(number)
        rows, total = rows + 1, total + size
        if rows >= bulk_size or total >= byte_size:
            number, rows, total = number + 1, 0, 0
    return out


@pytest.mark.parametrize("seed", range(30))
def test_next_starts_make_the_batches_of_the_plain_loop(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 50, 1000]) for _ in range(rng.randint(1, 300))]
    bulk, limit = rng.randint(1, 20), rng.choice([1, 10, 100, 1500])
    following = batches.next_starts(np.array(sizes), bulk, limit)
    got, at, number = [], 0, 0
    while at < len(sizes):
        end = min(int(following[at]), len(sizes))
        got += [number] * (end - at)
        at, number = end, number + 1
    assert got == brute_batches(sizes, bulk, limit)


def test_positions_are_the_sorted_order(spark):
    rng = random.Random(2)
    paths = {f"/d/{'hot' if rng.random() < 0.6 else rng.randint(0, 9)}/f{i}" for i in range(500)}
    frame = spark.createDataFrame([(p,) for p in paths], "p string").withColumn(
        "ord", walk_order(F.col("p"))
    )
    got = with_position(frame, ["ord"], slices=7).orderBy("position").collect()
    assert [r.position for r in got] == list(range(500))
    assert [r.p for r in got] == sorted(paths, key=lambda p: p.split("/"))


@pytest.mark.parametrize("slice_rows", [20, 33, 150, 100_000])
def test_batches_do_not_depend_on_slices(spark, slice_rows):
    rng = random.Random(4)
    sizes = {f"/d/{i:04}": rng.choice([1, 10, 400]) for i in range(600)}
    frame = spark.createDataFrame(list(sizes.items()), "path string, bytes bigint")
    rows = batches.bulk_batches(frame, ["path"], 20, 1000, slice_rows).collect()
    got = {r.path: r.batch for r in rows}
    ordered = sorted(sizes)
    assert [got[p] for p in ordered] == brute_batches([sizes[p] for p in ordered], 20, 1000)
    assert batches.bulk_batches(frame.limit(0), ["path"], 20, 1000, slice_rows).collect() == []


def log_frame(spark, rows):
    schema = struct(
        run_id=T.LongType(), phase=T.IntegerType(), ord=STRINGS, op=T.StringType(),
        _index=T.StringType(), _id=T.StringType(), doc=T.StringType(),
    )
    return spark.createDataFrame(rows, schema)


def replay(rows):
    current = {}
    for run, phase, ord_, op, index, key, doc in sorted(rows, key=lambda r: r[:3]):
        if op == "index":
            current[index, key] = doc
        elif op == "delete":
            current.pop((index, key), None)
    return current


@pytest.mark.parametrize("seed", range(3))
def test_current_state_equals_a_replay(spark, seed):
    rng = random.Random(seed)
    rows, seen = [], set()
    for n in range(800):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 60)}"
        order = (rng.randint(1, 6), rng.randint(0, 2), tuple(f"/a/{rng.randint(0, 50)}-b".split("/")))
        if (order, key) in seen:
            continue
        seen.add((order, key))
        op = rng.choice(["index", "index", "delete", "error"])
        index = rng.choice(["docs", "other"])
        rows.append((order[0], order[1], list(order[2]), op, index, None if op == "error" else key, f"doc {n}"))
    log = log_frame(spark, rows)
    got = {(r._index, r._id): r.doc for r in state.current_state(log).collect()}
    assert got == replay(rows)
    early, late = [r for r in rows if r[0] <= 3], [r for r in rows if r[0] > 3]
    base = state.current_state(log_frame(spark, early))
    stepped = state.current_state(log_frame(spark, late), base)
    assert {(r._index, r._id): r.doc for r in stepped.collect()} == replay(rows)
    counts = {r._index: r.documents for r in state.documents_per_index(log).collect()}
    assert counts == Counter(index for index, _ in replay(rows))
    newer = log_frame(spark, late)
    last = state.last_operations(newer)
    settled = state.untouched(base, last).unionByName(state.settled_rows(newer, last, lambda df: df))
    assert sorted((r._index, r._id, r.doc) for r in settled.collect()) == sorted(
        (*key, doc) for key, doc in replay(rows).items()
    )
    # The older half turns up late: only what is newer than the state counts.
    ahead = state.current_state(newer)
    tombs = state.last_operations(newer).filter("op = 'delete'").select(*state.KEY, *state.ORDER)
    known = ahead.select(*state.KEY, *state.ORDER).unionByName(tombs)
    caught_up = state.current_state(log_frame(spark, early), ahead, known)
    assert {(r._index, r._id): r.doc for r in caught_up.collect()} == replay(rows)


def test_change_feed_statuses(spark):
    now = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "path string, mtime double")
    before = spark.createDataFrame([("a", 1.0), ("b", 9.0), ("z", 4.0)], "path string, mtime double")
    got = {r.path: r.status for r in diff.change_feed(now, before).collect()}
    assert got == {"a": "unchanged", "b": "modified", "c": "new", "z": "deleted"}
    assert {r.path for r in diff.new_or_modified(now, before).collect()} == {"b", "c"}
    assert {r.path for r in diff.deleted(now, before).collect()} == {"z"}
    assert diff.deleted(now, before, remove_deleted=False).collect() == []


def test_change_feed_shuffles_each_side_once_and_no_text(spark, tmp_path):
    spark.range(1000).selectExpr(
        "concat('/d/', id) as path", "cast(id as double) as mtime", "repeat('x', 100) as text"
    ).write.parquet(str(tmp_path / "f"))
    now = spark.read.parquet(str(tmp_path / "f"))
    feed = diff.change_feed(now.select("path", "mtime"), now.select("path", "mtime"))
    plan = feed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2
    assert "text" not in plan


def make_events(count, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(count):
        # A third of the events fall on one path and one day.
        hot = rng.random() < 0.4
        moment = start + timedelta(hours=12 if hot else rng.uniform(0, 240), seconds=i)
        path = "/d/hot.txt" if hot else f"/d/{rng.randint(0, 30)}{rng.choice(['.txt', '.tmp'])}"
        rows.append((i, moment, rng.choice(["created", "modified", "deleted"]), path, rng.random() < 0.1))
    return rows


def test_events_pauses_and_last_event(spark):
    rows = make_events(2000, 7)
    pauses = [(r[1], r[1] + timedelta(minutes=m)) for r, m in zip(rows[::60], [1, 30, 2000, 0, 600] * 9)]
    options = CrawlOptions(root="/d", excludes=["*.tmp"], includes=["*.t*"])
    frame = spark.createDataFrame(rows, EVENTS)
    closed = spark.createDataFrame(
        pauses, struct(start_ts=T.TimestampNTZType(), end_ts=T.TimestampNTZType())
    )
    open_ = [r for r in rows if not any(s <= r[1] < e for s, e in pauses)]
    assert 0 < len(open_) < len(rows)
    for threshold in ("10MB", "-1"):  # broadcast and shuffled pauses
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = {r.event_id for r in filters.outside_pauses(frame, closed).collect()}
        assert got == {r[0] for r in open_}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    middle = rows[1000][1]
    unended = closed.unionByName(spark.createDataFrame([(middle, None)], closed.schema))
    got = {r.event_id for r in filters.outside_pauses(frame, unended).collect()}
    assert got == {r[0] for r in open_ if r[1] < middle}
    taken = [r for r in open_ if not r[4] and (r[2] == "deleted" or not r[3].endswith(".tmp"))]
    accepted = events.accepted_events(frame, options, closed)
    assert {r.event_id for r in accepted.collect()} == {r[0] for r in taken}
    last = {}
    for r in sorted(taken, key=lambda r: (r[1], r[0])):
        last[r[3]] = (r[0], "delete" if r[2] == "deleted" else "index")
    got = events.latest_events(accepted).collect()
    assert {r.path: (r.event_id, r.op) for r in got} == last


@pytest.mark.parametrize("day", [datetime(2024, 3, 10), datetime(2024, 11, 3)])
def test_pauses_where_the_session_zone_skips_or_repeats_an_hour(spark, day):
    rows = [(i, day + timedelta(minutes=10 * i), "created", f"/d/{i}", False) for i in range(60)]
    pauses = [(day + timedelta(minutes=a), day + timedelta(minutes=b)) for a, b in ((55, 125), (150, 155), (178, 245))]
    schema = struct(start_ts=T.TimestampNTZType(), end_ts=T.TimestampNTZType())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        kept = filters.outside_pauses(
            spark.createDataFrame(rows, EVENTS), spark.createDataFrame(pauses, schema)
        )
        got = {r.event_id for r in kept.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {r[0] for r in rows if not any(s <= r[1] < e for s, e in pauses)}


def test_facets_equal_counting_every_ancestor(spark):
    rng = random.Random(9)
    paths = {f"/r/{'hot' if rng.random() < 0.5 else rng.choice('abc')}/{rng.choice('xyz')}/{i}" for i in range(200)}
    paths |= {"/top.txt", "rel/a", "plain", "C:\\win\\f"}
    expected = Counter()
    for path in (p.replace("\\", "/") for p in paths):
        parts = path.split("/")
        expected.update(n for n in ("/".join(parts[:i]) for i in range(1, len(parts) + 1)) if n)
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.node: r.files for r in facets.path_tree_facets(frame).collect()} == expected


def test_terms(spark):
    texts = {1: "Été, été 2024-01!", 2: "a_b été", 3: "", 4: None}
    frame = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    got = {(r.term, r.id): r.tf for r in terms.term_postings(frame, "id", "text").collect()}
    assert got == {("été", 1): 2, ("2024", 1): 1, ("01", 1): 1, ("a", 2): 1, ("b", 2): 1, ("été", 2): 1}
    df = {r.term: r.df for r in terms.document_frequency(frame, "text").collect()}
    assert df == {"été": 2, "2024": 1, "01": 1, "a": 1, "b": 1}


UPLOADS = struct(
    upload_id=T.LongType(), filename=T.StringType(), content_type=T.StringType(),
    doc_id=T.StringType(), index=T.StringType(), simulate=T.BooleanType(), debug=T.BooleanType(),
    data=T.BinaryType(),
)


def test_uploads(spark, tmp_path):
    rows = [
        (1, "dir/a.TXT", "text/x; q=1", None, None, False, True, b" one "),
        (2, "b.txt", "", "id-2", "other", False, False, b"two"),
        (3, "c.txt", None, "", "", True, True, b"three"),
        (4, "dir/a.TXT", None, None, None, False, False, b"newer"),
        (5, "bad.txt", None, None, None, False, False, b"broken"),
    ]

    def fails(data):
        if data == b"broken":
            raise ValueError("no")
        return {"X-TIKA:content": data.decode(), "Content-Type": "a/b"}

    options = CrawlOptions(root="/d", name="job", store_source=True, id_mode="content")
    moment = F.lit("2024-02-01T00:00:00Z").cast("timestamp")
    built = uploads.build_uploads(
        spark.createDataFrame(rows, UPLOADS), PythonExtractor(fails), options, moment
    ).cache()
    got = {r.upload_id: r for r in uploads.upload_results(built).collect()}
    assert [got[i].ok for i in range(1, 6)] == [True, True, True, True, False]
    assert got[5].error == "ValueError: no" and got[5].url is None
    assert [got[i].url for i in range(1, 5)] == [
        "/job_docs/_doc/dir/a.TXT", "/other/_doc/id-2", "/job_docs/_doc/c.txt", "/job_docs/_doc/dir/a.TXT",
    ]
    doc = got[1].doc
    assert (doc.content, doc.file.content_type, doc.file.extension, doc.file.filename) == ("one", "text/x", "txt", "a.TXT")
    assert (doc.path.real, doc.path.virtual, doc.file.url, doc.attachment) == ("dir/a.TXT", "/a.TXT", "", None)
    assert doc.file.last_modified == doc.file.indexing_date and doc.file.created is None
    assert got[2].doc is None and got[3].doc.file.content_type == "a/b"
    log = upload_ops(built, options).withColumn("run_id", F.lit(1))
    current = {(r._index, r._id): r.doc.content for r in state.current_state(log).collect()}
    assert current == {("job_docs", "dir/a.TXT"): "newer", ("other", "id-2"): "two"}
    built.unpersist()
    store = DocumentStore(spark, str(tmp_path / "store"))
    frame = spark.createDataFrame(rows, UPLOADS)
    run = apply_uploads(frame, store, options, PythonExtractor(fails), batch_id=0)
    assert apply_uploads(frame.limit(0), store, options, PythonExtractor(fails), batch_id=0) == run
    answers = {r.upload_id: (r.ok, r.error, r.doc is not None) for r in store.responses(run).collect()}
    assert answers == {
        1: (True, None, True), 2: (True, None, False), 3: (True, None, True),
        4: (True, None, False), 5: (False, "ValueError: no", False),
    }
    assert {(r._index, r._id): r.content for r in store.documents().collect()} == current
    wanted = struct(key=T.StringType(), index=T.StringType())
    requests = spark.createDataFrame([("dir/a.TXT", None), ("dir/a.TXT", ""), ("x", "other")], wanted)
    apply_deletes(requests, store, options)
    assert [tuple(r) for r in store.counts().collect()] == [("other", 1)]
    plain = text_extractor(spark.createDataFrame(rows[:1], UPLOADS)).first()
    assert plain.text == [" one "] and plain.error is None


def test_extractor_takes_the_first_of_several_answers():
    one = PythonExtractor(lambda data: [{"a": 1, "X-TIKA:content": ["x", "y"]}, {"b": 2}]).one
    assert one(b"") == ({"a": ["1"]}, ["x", "y"], None)
    assert PythonExtractor(lambda data: []).one(b"") == ({}, None, None)


def test_equal_and_negative_upload_ids(spark):
    schema = "upload_id long, filename string, content_type string, doc_id string, index string, simulate boolean, debug boolean, data binary"
    rows = [(n, f, None, None, None, None, None, t) for n, f, t in (
        (7, "a.txt", b"x"), (7, "a.txt", b"y"), (7, "b.txt", b"same"), (7, "b.txt", b"same"),
        (-9, "c.txt", b"first"), (-1, "c.txt", b"last"), (-1, "d.txt", b"first"), (3, "d.txt", b"last"))]
    options = CrawlOptions(root="/d")
    built = uploads.build_uploads(spark.createDataFrame(rows, schema), text_extractor, options, F.lit("2024-01-01").cast("timestamp"))
    now = state.current_state(upload_ops(built, options).withColumn("run_id", F.lit(1)))
    found = sorted((r._id, r.doc.content) for r in now.collect())
    assert [f for f, _ in found] == ["a.txt", "b.txt", "c.txt", "d.txt"]
    assert dict(found)["c.txt"] == dict(found)["d.txt"] == "last" and dict(found)["a.txt"] in ("x", "y")
