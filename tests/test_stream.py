import os
import sys
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark import cloudpickle
from pyspark.sql import types as T

from docsnap.operators.extract import PythonExtractor
from docsnap.options import CrawlOptions
from docsnap.plans.crawl import crawl
from docsnap.plans.store import DocumentStore
from docsnap.schema import EVENTS, struct
from docsnap.streaming.events import crawl_then_follow, follow_events, read_events
from docsnap.streaming.recrawl import recrawl

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOON = datetime(2024, 1, 1, 12)


def parse(data):
    if data == b"broken":
        raise ValueError("cannot parse")
    return {"X-TIKA:content": data.decode()}


EXTRACTOR = PythonExtractor(parse)


@pytest.fixture
def feed(spark, tree, tmp_path):
    class Feed:
        place = str(tmp_path / "events")
        store = DocumentStore(spark, str(tmp_path / "store"))
        options = CrawlOptions(root=tree.root, excludes=["*.tmp"])
        sent = 0

        def send(self, *changes, at=NOON):
            """One file of events: each a kind and a path below the root."""
            rows = []
            for kind, name in changes:
                self.sent += 1
                moment = at + timedelta(seconds=self.sent)
                rows.append((self.sent, moment, kind, f"{tree.root}/{name}", name.endswith("/")))
            spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(self.place)

        def apply(self, **more):
            options = more.pop("options", self.options)
            follow_events(
                read_events(spark, self.place, maxFilesPerTrigger="1"), self.store, options,
                str(tmp_path / "checkpoint"), EXTRACTOR, trigger={"availableNow": True}, **more,
            ).awaitTermination()

        def docs(self):
            return {
                os.path.relpath(r._id, tree.root): r.content
                for r in self.store.documents().collect()
            }

    return Feed()


def test_events_end_in_the_state_of_the_tree(spark, feed, tree, tmp_path):
    for name in ("a.txt", "b.txt", "c.tmp", "sub/d.txt"):
        tree(name, name)
    feed.send(("created", "a.txt"), ("created", "c.tmp"), ("created", "sub/"), ("modified", "a.txt"))
    feed.send(("created", "b.txt"), ("created", "sub/d.txt"), ("created", "gone.txt"))
    feed.apply()
    os.remove(f"{tree.root}/b.txt")
    tree("a.txt", "second")
    feed.send(("deleted", "a.txt"), ("created", "a.txt"))
    feed.send(("modified", "b.txt"), ("deleted", "b.txt"), ("deleted", "c.tmp"))
    feed.apply()
    assert feed.docs() == {"a.txt": "second", "sub/d.txt": "sub/d.txt"}
    fresh = DocumentStore(spark, str(tmp_path / "fresh"))
    crawl(spark, feed.options, fresh, EXTRACTOR)
    assert {r._id for r in fresh.documents().collect()} == {f"{tree.root}/{n}" for n in feed.docs()}


def test_failures_do_not_stop_the_stream(feed, tree):
    tree("a.txt", "one")
    tree("b.txt", "two")
    feed.send(("created", "a.txt"), ("created", "b.txt"))
    feed.apply()
    tree("a.txt", "broken")
    tree("b.txt", "three")
    feed.send(("modified", "a.txt"), ("modified", "b.txt"))
    feed.apply()
    assert feed.docs() == {"a.txt": "one", "b.txt": "three"}
    assert [r.error for r in feed.store.errors().collect()] == ["ValueError: cannot parse"]


def test_pauses_drop_events(spark, feed, tree):
    tree("a.txt", "one")
    tree("b.txt", "two")
    feed.send(("created", "a.txt"))
    feed.send(("created", "b.txt"), at=NOON + timedelta(hours=2))
    pauses = spark.createDataFrame(
        [(NOON - timedelta(days=3), NOON + timedelta(hours=1))],
        struct(start_ts=T.TimestampNTZType(), end_ts=T.TimestampNTZType()),
    )
    feed.apply(pauses=pauses)
    assert feed.docs() == {"b.txt": "two"}


def test_content_ids_are_never_deleted(feed, tree):
    options = CrawlOptions(root=tree.root, id_mode="content")
    tree("a.txt", "one")
    feed.send(("created", "a.txt"))
    feed.apply(options=options)
    os.remove(f"{tree.root}/a.txt")
    feed.send(("deleted", "a.txt"))
    feed.apply(options=options)
    assert list(feed.docs().values()) == ["one"]


def test_crawl_then_follow(spark, feed, tree, tmp_path):
    tree("old.txt", "old")
    tree("new.txt", "new")
    before, after = datetime.now(timezone.utc).replace(tzinfo=None) - timedelta(hours=1), datetime.now(timezone.utc).replace(tzinfo=None) + timedelta(hours=1)
    feed.send(("deleted", "old.txt"), at=before)  # older than the pass: must not count
    feed.send(("deleted", "new.txt"), at=after)
    crawl_then_follow(
        spark, read_events(spark, feed.place), feed.store, feed.options,
        str(tmp_path / "checkpoint"), EXTRACTOR, trigger={"availableNow": True},
    ).awaitTermination()
    assert feed.docs() == {"old.txt": "old"}


def test_stream_starts_after_a_failed_pass(spark, feed, tree, tmp_path):
    tree("a.txt", "broken")
    tree("b.txt", "fine")
    feed.send(("created", "b.txt"), at=datetime.now(timezone.utc).replace(tzinfo=None) + timedelta(hours=1))
    crawl_then_follow(
        spark, read_events(spark, feed.place), feed.store, feed.options,
        str(tmp_path / "checkpoint"), EXTRACTOR, trigger={"availableNow": True},
    ).awaitTermination()
    assert feed.docs() == {"b.txt": "fine"}


def test_restart_with_a_backlog_and_a_failed_pass(spark, feed, tree, tmp_path):
    def now(**shift):
        return datetime.now(timezone.utc).replace(tzinfo=None) + timedelta(**shift)

    def follow():
        crawl_then_follow(
            spark, read_events(spark, feed.place), feed.store, feed.options,
            str(tmp_path / "checkpoint"), EXTRACTOR, trigger={"availableNow": True},
        ).awaitTermination()

    tree("a.txt", "one")
    feed.send(("created", "a.txt"), at=now())
    follow()
    assert feed.docs() == {"a.txt": "one"}
    tree("while_down.txt", "new")
    feed.send(("created", "while_down.txt"), at=now())
    tree("zz.txt", "broken")  # the pass at the restart fails
    time.sleep(1.1)
    follow()
    assert feed.docs() == {"a.txt": "one", "while_down.txt": "new"}


def test_recrawl(spark, feed, tree, tmp_path):
    tree("a.txt", "one")
    query = recrawl(
        spark, feed.options, feed.store, str(tmp_path / "checkpoint"), EXTRACTOR, every_seconds=1
    )
    try:
        deadline = time.time() + 90
        while "a.txt" not in feed.docs() and time.time() < deadline:
            time.sleep(0.5)
        tree("b.txt", "two")
        while "b.txt" not in feed.docs() and time.time() < deadline:
            time.sleep(0.5)
    finally:
        query.stop()
    assert feed.docs() == {"a.txt": "one", "b.txt": "two"}
