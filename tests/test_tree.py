import os
import socket

import pytest
from pyspark.sql import functions as F

from docsnap.options import CrawlOptions
from docsnap.plans.crawl import list_eligible
from docsnap.sources import snapshot
from docsnap.sources.snapshot import json_snapshot
from docsnap.sources.tree import binary_file_listing, list_names, with_stats


def listed(spark, root, **options):
    rows = list_names(spark, root, **options).collect()
    files = {r.path for r in rows if not r.is_dir and r.error is None}
    folders = {r.path for r in rows if r.is_dir and r.error is None}
    errors = {r.path: r.error for r in rows if r.error is not None}
    assert len(rows) == len(files) + len(folders) + len(errors)
    return files, folders, errors


def eligible(spark, root, **options):
    options = CrawlOptions(root=root, **options)
    names = list_names(spark, root, options.follow_symlinks, options.continue_on_error)
    return {r.path: r for r in list_eligible(names, options).collect()}


def test_odd_names_and_empty_folders(spark, tree):
    made = {
        tree(n)
        for n in [".h.txt", "_u/x.txt", ".git/config", "a b.txt", "new\nline.txt", "é/ü.txt",
                  "deep/er/est/file", "quote'\".txt"]
    }
    os.mkdir(f"{tree.root}/empty")
    files, folders, errors = listed(spark, tree.root + "/")
    assert files == made
    walked = {path for path, _, _ in os.walk(tree.root)}
    assert folders == walked
    assert errors == {}


def test_name_that_is_not_utf8_is_an_error_row(spark, tree):
    kept = tree("a.txt")
    with open(os.fsencode(tree.root) + b"/bad\xff.txt", "wb"):
        pass
    files, _, errors = listed(spark, tree.root)
    assert files == {kept}
    assert list(errors.values()) == ["the name is not UTF-8"]


def test_links(spark, tree, tmp_path):
    inside = tree("a/real.txt")
    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "far.txt").write_text("far away")
    os.symlink(outside / "far.txt", f"{tree.root}/link.txt")
    os.symlink(outside, f"{tree.root}/linked")
    os.symlink("/nowhere", f"{tree.root}/broken")
    os.symlink(tree.root, f"{tree.root}/a/loop")
    files, folders, _ = listed(spark, tree.root)
    assert files == {inside}
    assert folders == {tree.root, f"{tree.root}/a"}
    files, folders, _ = listed(spark, tree.root, follow_symlinks=True)
    assert files == {inside, f"{tree.root}/link.txt", f"{tree.root}/linked/far.txt"}
    assert folders == {tree.root, f"{tree.root}/a", f"{tree.root}/linked"}
    stats = eligible(spark, tree.root, follow_symlinks=True)
    assert stats[f"{tree.root}/link.txt"].length == len("far away")


def test_sockets_are_not_files(spark, tree):
    kept = tree("a")
    with socket.socket(socket.AF_UNIX) as s:
        s.bind(f"{tree.root}/s")
    assert listed(spark, tree.root)[0] == {kept}


@pytest.mark.skipif(os.geteuid() == 0, reason="root may read everything")
def test_unreadable_folder(spark, tree):
    kept = tree("a.txt")
    tree("closed/b.txt")
    os.chmod(f"{tree.root}/closed", 0)
    try:
        files, folders, errors = listed(spark, tree.root, continue_on_error=True)
        assert files == {kept}
        assert f"{tree.root}/closed" in folders and f"{tree.root}/closed" in errors
        with pytest.raises(Exception, match="PermissionError"):
            listed(spark, tree.root)
    finally:
        os.chmod(f"{tree.root}/closed", 0o755)


def test_missing_root_fails(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFoundError"):
        listed(spark, str(tmp_path / "missing"))
    with pytest.raises(ValueError):
        list_names(spark, "relative/root")


def test_a_file_that_vanished_drops_out(spark, tree):
    kept = tree("a")
    frame = spark.createDataFrame([(kept,), (tree.root + "/gone",)], "path string")
    assert [r.path for r in with_stats(frame).collect()] == [kept]


def test_stats_keep_fractions_of_seconds(spark, tree):
    path = tree("a", "12345", mtime=1_700_000_000.123456)
    row = eligible(spark, tree.root)[path]
    assert (row.length, row.mtime) == (5, os.stat(path).st_mtime)


def test_size_limit_keeps_the_exact_size(spark, tree):
    paths = [tree(f"{n}.txt", "x" * n) for n in (10, 100, 101)]
    assert set(eligible(spark, tree.root, ignore_above=100)) == set(paths[:2])
    assert set(eligible(spark, tree.root)) == set(paths)


def test_patterns_see_the_name_only_and_never_prune_folders(spark, tree):
    kept = tree("skip.tmp/keep.pdf")
    tree("also_pdf.pdf")
    tree("x.txt")
    found = eligible(spark, tree.root, includes=["*.pdf"], excludes=["also_pdf.pdf", "*.tmp"])
    assert set(found) == {kept}
    assert eligible(spark, tree.root, includes=["*/*.pdf"]) == {}


def test_binary_file_listing(spark, tree):
    path = tree("sub/a.txt", "abc", mtime=1_700_000_000.123456)
    row = binary_file_listing(spark, tree.root).first()
    assert (row.path, row.length, row.mtime) == (path, 3, 1_700_000_000.123)


def test_size_guard_reaches_the_binary_file_scan(spark, tree):
    from docsnap.operators.filters import size_guard

    tree("a")
    plan = size_guard(binary_file_listing(spark, tree.root), 10)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,10)" in plan


@pytest.mark.parametrize("indent", [None, 2])
def test_json_snapshot(spark, tmp_path, indent):
    import json

    entries = {"/d/a.txt": 1.5, '/d/q"uote\n, {}.txt': 1700000000.123456, "/d/é": 3}
    place = tmp_path / "s.json"
    place.write_text(json.dumps(entries, indent=indent))
    rows = json_snapshot(spark, str(place)).collect()
    assert {r.path: r.mtime for r in rows} == entries


@pytest.mark.parametrize("size", [5, 13, 64, 1 << 20])
def test_json_snapshot_in_ranges(spark, tmp_path, monkeypatch, size):
    import json
    import random

    rng = random.Random(size)
    letters = ['"', "\\", ",", "{", "}", ":", " ", "é", "日", "\n", "a", "1.5", "\\\\"]
    entries = {"/" + "".join(rng.choices(letters, k=rng.randrange(12))): rng.random() * 1e9 for _ in range(40)}
    monkeypatch.setattr(snapshot, "RANGE_BYTES", size)
    monkeypatch.setattr(snapshot, "_BLOCK", 7)
    for k, text in enumerate([json.dumps(entries), json.dumps(entries, ensure_ascii=False, indent=1), " \n" + json.dumps(entries, separators=(",", ":")) + "\n "]):
        place = tmp_path / f"{k}.json"
        place.write_text(text)
        read = snapshot._entries(spark, f"file://{place}", len(text.encode()))
        assert {r.path: r.mtime for r in read.collect()} == entries
    assert {r.path: r.mtime for r in json_snapshot(spark, str(place)).collect()} == entries


@pytest.mark.parametrize(
    "text", ["", "{}", "{ not json", '{\n  "/a": 1.0,\n', '{"/a": "x"}', '{"/a": null}', "[1]", '{"/a": 1} x', 'x {"/a": 1}', '{"/a": {"b": 1}}', '{"/a": 1, "/b}', '{"/a": 1}{"/b": 2}']
)
def test_damaged_json_snapshot_is_empty(spark, tmp_path, text):
    place = tmp_path / "s.json"
    place.write_text(text)
    assert json_snapshot(spark, str(place)).collect() == []
    assert json_snapshot(spark, str(tmp_path / "missing.json")).collect() == []


def test_listing_rows_are_spread_over_tasks(spark, tree):
    for n in range(40):
        tree(f"hot/{n}.txt")
    names = list_names(spark, tree.root).filter(~F.col("is_dir"))
    stats = with_stats(names.select("path"), tasks=4)
    used = stats.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(used) == 4 and max(r["count"] for r in used) <= 20
