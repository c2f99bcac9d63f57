import hashlib
import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docsnap.operators.extract import PythonExtractor, default_extractor
from docsnap.operators.ops import bulk_requests, write_bulk_lines
from docsnap.options import CrawlOptions
from docsnap.plans.crawl import CrawlError, crawl, object_listing
from docsnap.plans.store import DocumentStore
from docsnap.schema import DOCUMENT
from docsnap.sources.snapshot import json_snapshot


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def canned(data):
    """A stand-in for an outside extractor."""
    if data.startswith(b"broken"):
        raise ValueError("cannot parse")
    return {
        "Content-Type": ["text/plain; charset=utf-8"],
        "dc:title": data.decode()[:5],
        "Author": ["first", "second"],
        "dc:date": "2024-01-01T00:00:00Z",
        "X-TIKA:content": [data.decode(), "end "],
        "empty": None,
    }


EXTRACTOR = PythonExtractor(canned)


@pytest.fixture
def job(spark, tree, tmp_path):
    class Job:
        store = DocumentStore(spark, str(tmp_path / "store"))

        def run(self, extractor=EXTRACTOR, **options):
            return crawl(spark, CrawlOptions(root=tree.root, **options), self.store, extractor)

        def docs(self):
            return {r._id: r for r in self.store.documents().collect()}

        def ops(self, run_id):
            rows = self.store.written_ops(run_id).filter("phase > 0").collect()
            return sorted((r.op, os.path.basename(r.path)) for r in rows)

    return Job()


def test_first_run_builds_documents_and_folders(spark, job, tree):
    a = tree("a.txt", "hello", mtime=1_700_000_000.25)
    tree("sub/b.PDF", "world")
    job.run(checksum="MD5", store_source=True)
    docs = job.docs()
    assert set(docs) == {a, f"{tree.root}/sub/b.PDF"}
    doc = docs[a]
    assert doc._index == "job_docs"
    assert doc.content == "hello\nend"
    assert doc.file.asDict() | {"indexing_date": 0, "last_accessed": 0} == {
        "content_type": "text/plain", "filename": "a.txt", "extension": "txt", "filesize": 5,
        "indexed_chars": 9, "indexing_date": 0, "last_accessed": 0, "created": None,
        "last_modified": doc.file.last_modified,
        "checksum": hashlib.md5(b"hello").hexdigest(), "url": a,
    }
    assert doc.file.last_modified.timestamp() == 1_700_000_000.25
    assert doc.path.asDict() == {"real": a, "root": tree.root, "virtual": "/a.txt"}
    assert (doc.meta.title, doc.meta.author, doc.meta.date.year) == ("hello", "first", 2024)
    assert bytes(doc.attachment) == b"hello"
    folders = {r._id: r for r in job.store.folders().collect()}
    assert {i: r.path.virtual for i, r in folders.items()} == {
        tree.root: "/", f"{tree.root}/sub": "/sub",
    }
    assert {r._index for r in folders.values()} == {"job_folder"}
    counts = job.store.alias().groupBy("_index").count().collect()
    assert {tuple(r) for r in counts} == {("job_docs", 2), ("job_folder", 2)}


def test_second_run_takes_only_what_changed(job, tree):
    for n in "abcd":
        tree(f"{n}.txt", n, mtime=1_700_000_000)
    job.run()
    tree("b.txt", "b2", mtime=1_700_000_001)
    tree("c.txt", "c2", mtime=1_600_000_000)  # backwards counts as well
    os.remove(f"{tree.root}/d.txt")
    tree("e.txt", "e")
    run = job.run()
    assert job.ops(run) == [
        ("delete", "d.txt"), ("index", "b.txt"), ("index", "c.txt"), ("index", "e.txt"),
    ]
    assert {os.path.basename(i): r.content for i, r in job.docs().items()} == {
        "a.txt": "a\nend", "b.txt": "b2\nend", "c.txt": "c2\nend", "e.txt": "e\nend",
    }
    assert job.ops(job.run()) == []


def test_incremental_runs_end_like_a_fresh_one(spark, job, tree, tmp_path):
    for n in range(12):
        tree(f"d{n % 3}/f{n}.txt", f"v{n}", mtime=1_700_000_000)
    job.run()
    for n in range(0, 12, 2):
        tree(f"d{n % 3}/f{n}.txt", f"w{n}", mtime=1_700_000_100)
    os.remove(f"{tree.root}/d1/f1.txt")
    tree("new/x.html", "<html lang='en'><title>T</title>body")
    job.run()
    job.store.compact()
    tree("d0/f3.txt", "again", mtime=1_700_000_200)
    job.run()
    fresh = DocumentStore(spark, str(tmp_path / "fresh"))
    crawl(spark, CrawlOptions(root=tree.root), fresh, EXTRACTOR)

    def state(store):
        return {
            (r._index, r._id, r.content, r.meta, r.path)
            for r in store.alias().collect()
        }

    assert state(job.store) == state(fresh)


def test_file_that_became_ineligible_is_deleted(job, tree):
    tree("a.txt")
    tree("b.tmp")
    tree("big.txt", "x" * 100)
    job.run()
    run = job.run(excludes=["*.tmp"], ignore_above=50)
    assert job.ops(run) == [("delete", "b.tmp"), ("delete", "big.txt")]


def test_remove_deleted_off_forgets_the_path(job, tree):
    path = tree("a.txt", "one", mtime=1_700_000_000)
    tree("b.txt")
    job.run()
    os.remove(path)
    assert job.ops(job.run(remove_deleted=False)) == []
    assert path in job.docs()
    assert job.ops(job.run()) == []  # the snapshot no longer knows it
    tree("a.txt", "one", mtime=1_700_000_000)
    assert job.ops(job.run()) == [("index", "a.txt")]


def test_failures_stop_the_run_and_leave_no_trace(job, tree):
    tree("a.txt", "fine")
    tree("b.txt", "broken")
    with pytest.raises(CrawlError, match="b.txt: ValueError: cannot parse"):
        job.run()
    assert job.docs() == {} and job.store.snapshot().collect() == []
    tree("b.txt", "mended")
    assert job.run() == 2  # ids are never used again
    assert len(job.docs()) == 2


def test_failures_can_be_skipped_and_are_tried_again(job, tree):
    tree("a.txt", "fine", mtime=1_700_000_000)
    path = tree("b.txt", "fine too", mtime=1_700_000_000)
    job.run(continue_on_error=True)
    tree("b.txt", "broken", mtime=1_700_000_001)
    tree("c.txt", "broken")
    run = job.run(continue_on_error=True)
    assert job.ops(run) == [("error", "b.txt"), ("error", "c.txt")]
    assert job.docs()[path].content == "fine too\nend"  # the stored document stays
    errors = {(os.path.basename(r.path), r.error) for r in job.store.errors().collect()}
    assert errors == {("b.txt", "ValueError: cannot parse"), ("c.txt", "ValueError: cannot parse")}
    run = job.run(continue_on_error=True)
    assert job.ops(run) == [("error", "b.txt"), ("error", "c.txt")]
    os.remove(path)
    run = job.run(continue_on_error=True, retry_failed=False)
    assert job.ops(run) == [("delete", "b.txt"), ("error", "c.txt")]
    assert job.ops(job.run(continue_on_error=True)) == []


def test_slow_files_are_cut_off(job, tree):
    def slow(data):
        import time

        time.sleep(30 if data == b"slow" else 0)
        return {"X-TIKA:content": "ok"}

    tree("a.txt", "slow")
    tree("b.txt", "fast")
    run = job.run(PythonExtractor(slow, time_limit=0.3), continue_on_error=True)
    assert job.ops(run) == [("error", "a.txt"), ("index", "b.txt")]
    assert "TimeoutError" in job.store.errors().first().error


def test_ids_by_content(job, tree):
    tree("a/one.txt", "same")
    last = tree("a/two.txt", "same")
    other = tree("b.txt", "other", mtime=1_700_000_000)
    job.run(id_mode="content")
    docs = job.docs()
    same = hashlib.sha256(b"same").hexdigest()
    assert set(docs) == {same, hashlib.sha256(b"other").hexdigest()}
    assert docs[same].path.real == last  # the later one of the walk
    assert docs[same].file.checksum == same
    os.remove(last)
    tree("b.txt", "changed", mtime=1_700_000_001)
    assert job.ops(job.run(id_mode="content")) == [("index", "b.txt")]
    assert len(job.docs()) == 3  # nothing is ever removed
    assert other in {r.path.real for r in job.docs().values()}


def test_ids_by_path_hash(job, tree):
    path = tree("a.txt")
    job.run(id_mode="path_hash")
    assert set(job.docs()) == {hashlib.sha256(path.encode()).hexdigest()}
    os.remove(path)
    job.run(id_mode="path_hash")
    assert job.docs() == {}


def test_folders_stay_unless_pruned(job, tree):
    tree("sub/a.txt")
    job.run()
    os.remove(f"{tree.root}/sub/a.txt")
    os.rmdir(f"{tree.root}/sub")
    job.run()
    assert job.store.folders().count() == 2
    job.run(prune_folders=True)
    assert [r._id for r in job.store.folders().collect()] == [tree.root]


def test_folders_can_be_left_out(job, tree):
    tree("sub/a.txt")
    job.run(index_folders=False)
    assert job.store.folders().collect() == []
    assert job.store.documents().count() == 1


def test_content_options(job, tree):
    path = tree("a.txt", "A" * 1000)
    job.run(indexed_chars=10)
    assert job.docs()[path].content == "A" * 10
    os.utime(path, (1, 1))
    job.run(index_content=False)
    assert (job.docs()[path].content, job.docs()[path].file.indexed_chars) == (None, 0)


def test_built_in_extraction(spark, job, tree, tmp_path):
    from docsnap.operators.extract import default_extractor

    page = "<html><head lang=x><title> A &amp;\n B</title></head><body>x<script>no</script> <b>y</b>&lt;</body>"
    html = tree("p.HTML", page.replace("<html>", "<html class='k' lang=\"de\">"))
    text = tree("t.txt", b" caf\xc3\xa9 \xff ")
    job.run(default_extractor)
    docs = job.docs()
    assert docs[html].content == "A & B x y <"
    assert (docs[html].meta.title, docs[html].meta.language) == ("A & B", "de")
    assert docs[html].file.content_type == "text/html"
    assert docs[text].content == "café �"
    assert docs[text].meta is None


def test_pages_are_read_whole(spark, job, tree):
    page = (
        b"<html><head><meta charset='windows-1252'><meta name=author content='A &amp; B'>"
        b"<META property=\"og:title\" content=Other><meta name='DC.subject' content='x y'><title>T&#233;</title></head>"
        b"<body>caf\xe9 \x80 &eacute;&#x41;&nbsp;&copy;&amp;lt; <!-- a --> b <script>var x = 1;</script> c <style>p { open"
    )
    html = tree("p.html", page)
    job.run(default_extractor)
    doc = job.docs()[html]
    assert doc.content == "Té café € éA ©&lt; b c"
    assert (doc.meta.title, doc.meta.author) == ("Té", "A & B")


def test_bulk_requests_keep_to_their_limits(spark, job, tree):
    for n in range(30):
        tree(f"f{n:02}.txt", "x" * (n * 40), mtime=1_700_000_000)
    job.run(index_folders=False)
    options = CrawlOptions(root=tree.root, bulk_size=7, byte_size=3_000)
    found = bulk_requests(job.store.ops(), options).orderBy("batch").collect()
    assert [r.batch for r in found] == list(range(len(found))) and len(found) > 5
    sizes = []
    for r in found:
        lines = r.body.split("\n")
        assert r.operations <= 7 and len(lines) == 2 * r.operations and r.bytes == len(r.body.encode()) + 1
        pairs = [len((a + "\n" + b + "\n").encode()) for a, b in zip(lines[::2], lines[1::2], strict=True)]
        assert sum(pairs[:-1]) < 3_000
        sizes.append(sum(pairs))
    assert sum(r.operations for r in found) == 30


def test_bulk_lines_alternate_in_order(spark, job, tree):
    for n in range(20):
        tree(f"d{n % 4}/f{n}.txt", f"text {n}", mtime=1_700_000_000)
    job.run()
    os.remove(f"{tree.root}/d0/f0.txt")
    job.run(index_folders=False)
    target = job.store.location + "/lines"
    write_bulk_lines(job.store.ops(), target, CrawlOptions(root=tree.root, bulk_size=3))
    lines = []
    for name in sorted(f for f in os.listdir(target) if f.startswith("part-")):
        with open(f"{target}/{name}") as handle:
            lines += [json.loads(line) for line in handle]
    order = []
    while lines:
        action = lines.pop(0)
        (kind, where), = action.items()
        order.append((kind, where["_index"], where["_id"]))
        if kind == "index":
            body = lines.pop(0)
            assert body["path"]["real"] == where["_id"]
            assert ("content" in body) == (where["_index"] == "job_docs")
    assert len(order) == 5 + 20 + 1
    assert [o[1] for o in order] == ["job_folder"] * 5 + ["job_docs"] * 21
    walk = [i.split("/") for _, index, i in order[5:25]]
    assert walk == sorted(walk)
    assert order[-1] == ("delete", "job_docs", f"{tree.root}/d0/f0.txt")


def test_a_repeated_batch_changes_nothing(spark, job, tree):
    tree("a.txt", "one")
    options = CrawlOptions(root=tree.root)
    first = crawl(spark, options, job.store, EXTRACTOR, source="s", batch_id=4)
    tree("a.txt", "two", mtime=5)
    assert crawl(spark, options, job.store, EXTRACTOR, source="s", batch_id=4) == first
    assert [r.content for r in job.docs().values()] == ["one\nend"]


def test_uncommitted_run_is_not_seen_and_overwritten(spark, job, tree):
    tree("a.txt", "one")
    job.run()
    before = job.docs()
    leftover = job.store.ops().withColumn("_id", F.lit("ghost"))
    job.store.write_ops(2, leftover)
    assert job.docs() == before
    tree("b.txt", "two")
    assert job.run() == 2
    assert "ghost" not in job.docs() and len(job.docs()) == 2


def test_compaction_and_pruning_keep_the_state(spark, job, tree):
    paths = [tree(f"{n}.txt", f"{n}", mtime=1_700_000_000) for n in range(5)]
    for step in range(4):
        job.run()
        job.store.compact()
        os.remove(paths[step])
        tree("4.txt", f"step {step}", mtime=1_700_000_010 + step)
    job.run()
    before = job.docs()
    assert {r.content for r in before.values()} == {"step 3\nend"}
    job.store.prune(keep=2)
    kept = {
        t: {int(n.split("=")[1]) for n in os.listdir(f"{job.store.location}/{t}") if "=" in n} - {0}
        for t in ("ops", "snapshot", "state")
    }
    pieces = {n for r in job.store._read("commits").collect() if r.run_id in (6, 8) for n in r.pieces}
    assert {6, 8} <= pieces
    assert kept == {"snapshot": {7, 9}, "state": pieces, "ops": {6, 7, 8, 9}}
    assert job.docs() == before
    assert job.ops(job.run()) == []


def test_a_compacted_state_is_not_moved_to_be_read(spark, job, tree):
    for n in range(8):
        tree(f"{n}.txt", f"{n}", mtime=1_700_000_000)
    job.run()
    job.store.compact()
    os.remove(f"{tree.root}/0.txt")
    tree("1.txt", "again", mtime=1_700_000_100)
    job.run()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = job.store.documents()._jdf.queryExecution().executedPlan().toString()
        docs = job.docs()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "Scan parquet" in line and "docsnap_state" in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    above = []  # the nodes on the way from the scan to the top
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            above.append(line)
            depth = own
    assert above and not [line for line in above if "Exchange" in line]
    assert {r.content for r in docs.values()} == {"again\nend", *(f"{n}\nend" for n in range(2, 8))}


def test_rejected_metadata_is_reported(spark, job, tree):
    path = tree("a.txt")
    job.run(PythonExtractor(lambda _: {"dc:date": "soon", "xmpMM:Rating": "7"}))
    doc = job.docs()[path]
    assert (doc.meta.date, doc.meta.rating) == (None, 7)
    assert [(r._id, r.field) for r in job.store.rejected_metadata().collect()] == [(path, "date")]


def test_two_roots_in_one_store(spark, job, tree, tmp_path):
    a = tree("a/one.txt", "one", mtime=1_700_000_000)
    b = tree("b/two.txt", "two", mtime=1_700_000_000)
    first, second = CrawlOptions(root=f"{tree.root}/a"), CrawlOptions(root=f"{tree.root}/b", prune_folders=True)
    crawl(spark, first, job.store, EXTRACTOR)
    crawl(spark, second, job.store, EXTRACTOR)
    assert set(job.docs()) == {a, b} and job.store.folders().count() == 2
    # Another source of the same job finds its snapshot; nothing is read again.
    assert job.ops(crawl(spark, first, job.store, EXTRACTOR, source="again")) == []
    os.remove(a)
    assert job.ops(crawl(spark, first, job.store, EXTRACTOR)) == [("delete", "one.txt")]
    assert set(job.docs()) == {b}


def test_two_writers_at_once(spark, job, tree):
    store = job.store
    one, two = store.begin("x")[0], store.begin("y")[0]
    assert (one, two) == (1, 2)
    tree("a.txt", "crawled")
    third = job.run()

    def op(key, text):
        return spark.range(1).select(
            F.lit(1).alias("phase"), F.array(F.lit(key)).alias("ord"), F.lit("index").alias("op"),
            F.lit("job_docs").alias("_index"), F.lit(key).alias("_id"), F.lit(key).alias("path"),
            F.lit(None).cast("string").alias("error"),
            F.from_json(F.to_json(F.struct(F.lit(text).alias("content"), F.struct(F.lit("n").alias("filename")).alias("file"))), DOCUMENT).alias("doc"),
        )

    store.write_ops(two, op("k", "second"))
    store.commit(two, "y", "uploads")
    store.compact()
    store.write_ops(one, op("k", "first").unionByName(op("late", "late")))
    assert {r.content for r in job.docs().values()} == {"second", "crawled\nend"}
    store.commit(one, "x", "uploads")  # committed after a compaction that did not cover it
    assert {r.content for r in job.docs().values()} == {"second", "crawled\nend", "late"}
    store.compact()
    assert {r.content for r in job.docs().values()} == {"second", "crawled\nend", "late"}
    store.prune(keep=1)
    assert {r.content for r in job.docs().values()} == {"second", "crawled\nend", "late"} and third == 3


def test_a_snapshot_from_elsewhere(spark, job, tree, tmp_path):
    path = tree("a.txt", "one", mtime=1_700_000_000)
    tree("b.txt", "two")
    (tmp_path / "old.json").write_text(json.dumps({path: 1_700_000_000.0}))
    options = CrawlOptions(root=tree.root)
    job.store.import_snapshot(options.job, json_snapshot(spark, str(tmp_path / "old.json")))
    assert job.ops(job.run()) == [("index", "b.txt")]


def test_listing_of_an_object_store(spark, job, tree):
    for n in range(6):
        tree(f"d{n % 2}/f{n}.txt", f"text {n}", mtime=1_700_000_000)
    tree("d0/x.tmp")
    options = CrawlOptions(root=tree.root, excludes=["*.tmp"])
    crawl(spark, options, job.store, EXTRACTOR, listing=object_listing)
    assert {r.content for r in job.docs().values()} == {f"text {n}\nend" for n in range(6)}
    assert {os.path.basename(r._id) for r in job.store.folders().collect()} == {"data", "d0", "d1"}
    os.remove(f"{tree.root}/d0/f0.txt")
    assert job.ops(crawl(spark, options, job.store, EXTRACTOR, listing=object_listing)) == [("delete", "f0.txt")]
