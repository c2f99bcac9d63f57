"""Extractors in a process of their own, and files that are too large."""

import ctypes
import os
import time

from docsnap.operators.extract import PythonExtractor
from docsnap.options import CrawlOptions
from docsnap.plans.crawl import crawl
from docsnap.plans.store import DocumentStore
from docsnap.sources import content


def unruly_function():
    """Made anew, so that it travels to workers by value."""

    def unruly(data):
        match data[:4]:
            case b"loop":
                ctypes.CDLL(None).sleep(60)  # native code, which no Python signal handler stops
            case b"wait":
                time.sleep(60)
            case b"much":
                return {"X-TIKA:content": str(len(bytearray(4 << 30)))}
            case b"dies":
                os._exit(3)
            case b"kill":
                ctypes.string_at(0)
            case b"fail":
                raise ValueError("no")
            case b"odd ":
                return {"x": lambda: 0}
        return {"X-TIKA:content": data.decode(), "pid": os.getpid()}

    return unruly


unruly = unruly_function()

ERRORS = {
    "loop": "TimeoutError: extraction took longer than 1 s",
    "wait": "TimeoutError: extraction took longer than 1 s",
    "much": "MemoryError: the function took too much memory",
    "dies": "ChildProcessError: extraction ended with exit code 3",
    "kill": "ChildProcessError: extraction ended with exit code -11",
    "fail": "ValueError: no",
}


def test_unruly_functions_become_errors():
    extractor = PythonExtractor(unruly, time_limit=1, memory_limit=2 << 30)
    for name, error in ERRORS.items():
        assert extractor.one(name.encode()) == (None, None, error)
        raw, text, problem = extractor.one(b"good one")
        assert (text, problem) == (["good one"], None) and int(raw["pid"][0]) != os.getpid()
    assert extractor.one(b"odd one")[2] is not None
    pids = {extractor.one(b"again")[0]["pid"][0] for _ in range(5)}
    assert len(pids) == 1  # one process answers call after call
    extractor.close()
    assert extractor.one(b"more")[1] == ["more"]
    extractor.close()


def test_others_go_on_in_a_crawl(spark, tree, tmp_path):
    for name in [*ERRORS, "good", "fine"]:
        tree(f"{name}.txt", f"{name} text")
    store = DocumentStore(spark, str(tmp_path / "store"))
    options = CrawlOptions(root=tree.root, continue_on_error=True)
    crawl(spark, options, store, PythonExtractor(unruly, time_limit=1, memory_limit=2 << 30))
    assert {r.content for r in store.documents().collect()} == {"good text", "fine text"}
    assert {os.path.basename(r.path)[:4]: r.error for r in store.errors().collect()} == ERRORS


def test_files_above_the_limit_are_errors(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setattr(content, "MOST_BYTES", 1000)
    monkeypatch.setattr(content, "_PIECE_BYTES", 300)
    for size in (0, 299, 300, 999, 1000, 1001, 5000):
        tree(f"{size}.txt", "x" * size)
    huge = tree("huge.txt")
    os.truncate(huge, 5 << 40)  # a hole of 5 TB
    store = DocumentStore(spark, str(tmp_path / "store"))
    crawl(spark, CrawlOptions(root=tree.root, continue_on_error=True, checksum="SHA-1"), store)
    assert sorted(len(r.content) for r in store.documents().collect()) == [0, 299, 300, 999, 1000]
    errors = {os.path.basename(r.path): r.error for r in store.errors().collect()}
    assert set(errors) == {"1001.txt", "5000.txt", "huge.txt"}
    assert set(errors.values()) == {"FileTooLarge: more than 1000 bytes"}


def test_a_file_that_grew_since_it_was_listed(tmp_path):
    path = tmp_path / "grown"
    path.write_bytes(b"y" * 10_000)
    assert content._whole(str(path), 10_000) == b"y" * 10_000
    try:
        content._whole(str(path), 9_999)
    except content.FileTooLarge:
        pass
    else:
        raise AssertionError
