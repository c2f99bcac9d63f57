import fnmatch
import hashlib
import html
import itertools
import json
import random
from base64 import b64encode
from datetime import datetime, timedelta, timezone
from pathlib import PurePosixPath

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsnap.functions import content, hashing, metadata, names, paths, render, units
from docsnap.operators import extract
from docsnap.schema import DOCUMENT, META_FIELDS, RAW_KEYS, struct


def column(spark, values, expression, kind="string"):
    """The results of a column expression, in the order of the values."""
    rows = list(enumerate(values))
    frame = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r.out for r in frame.select("i", expression.alias("out")).orderBy("i").collect()]


NAMES = [
    "a", "a.txt", "A.TXT", "x.tar.gz", ".bashrc", "a.", "..a", "a..b", "no", "with space.Md",
    "new\nline.pdf", "tail.txt\n", "[x].txt", "a-b", "a^b", "é.É", "a*b", "b]", "!", "a\\b",
]


def test_name_and_extension(spark):
    full = [f"/d.x/e/{n}" for n in NAMES]
    assert column(spark, full, names.file_name(F.col("v"))) == NAMES
    expected = [PurePosixPath(n).suffix.lstrip(".").lower() for n in NAMES]
    assert column(spark, NAMES, names.extension(F.col("v"))) == expected


def test_globs_match_like_fnmatch(spark):
    patterns = [
        "*", "*.txt", "a?b", "a*b*", "[ab]*", "[!a]*", "[a-c]*", "[]b]*", "[!]]*", "[", "[a",
        "a[", "*[.]*", "[c-a]", "[!c-a]", "[a-c-e]*", "[^a]*", "[[]*", "[&&a]*", "[a[b]*", "**",
        "*\n*", "*.tx[t]", "\\*", "a\\b", "[\\]*", "{a,b}", "(a)", "a|b", "+", "$", "[~|]*", "[a--b]*",
    ]
    rng = random.Random(5)
    for _ in range(300):
        patterns.append("".join(rng.choice("ab*?[]!-^.&|") for _ in range(rng.randint(1, 7))))
    samples = NAMES + ["".join(t) for t in itertools.product("ab-]!^.&", repeat=2)] + list("abce-]![^&|.")
    rows = [
        (p, rf"(?s)\A(?:{names.glob_regex(p)})\z", s, fnmatch.fnmatchcase(s, p))
        for p in patterns
        for s in samples
    ]
    frame = spark.createDataFrame(rows, "p string, r string, s string, want boolean")
    wrong = frame.filter(F.expr("rlike(s, r)") != F.col("want")).collect()
    assert wrong == []


def test_include_and_exclude_lists(spark):
    keep = names.passes_patterns(F.col("v"), ["*.pdf", "doc*"], ["also*", "*.tmp"])
    values = ["keep.pdf", "also_pdf.pdf", "skip.txt", "doc.tmp", "doc.txt", "DOC.txt"]
    assert column(spark, values, keep) == [True, False, False, False, True, False]
    assert column(spark, values, names.passes_patterns(F.col("v"))) == [True] * 6


def test_virtual_paths(spark):
    real = ["/data/a/b.txt", "/data2/c.txt", "/data", "/x/y"]
    assert column(spark, real, paths.virtual_path(F.col("v"), "/data/")) == [
        "/a/b.txt", "/c.txt", "/data", "/y",
    ]
    assert column(spark, real, paths.virtual_path(F.col("v"), "/")) == real
    assert column(spark, ["/data", "/data/s/t"], paths.folder_virtual_path(F.col("v"), "/data")) == [
        "/", "/s/t",
    ]


def test_tree_tokens(spark):
    values = ["/a/b/c", "a/b", "/", "//", "/a/", "C:\\x\\y", ""]
    assert column(spark, values, paths.tree_tokens(F.col("v"))) == [
        ["/a", "/a/b", "/a/b/c"], ["a", "a/b"], ["/"], ["/", "//"], ["/a", "/a/"],
        ["C:", "C:/x", "C:/x/y"], [],
    ]


def test_walk_order_is_depth_first(spark, tree):
    import os

    for name in ["a/x", "a-b", "a.c", "a/y/z", "a!", "b", "A/q", "é/1", "a/y-1"]:
        tree(name)

    def walk(folder):
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            if entry.is_dir():
                yield from walk(entry.path)
            else:
                yield entry.path

    expected = list(walk(tree.root))
    shuffled = random.Random(1).sample(expected, len(expected))
    frame = spark.createDataFrame([(p,) for p in shuffled], "p string")
    assert [r.p for r in frame.orderBy(paths.walk_order(F.col("p"))).collect()] == expected


def test_content_is_stripped_and_cut_like_text(spark):
    space = content.WHITE_SPACE
    assert set(space) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    values = [f"{space}a{space}b{space}", "😀é" * 5, "", space, "\u200bx\u200b"]
    for limit in (1, 3, 100, 0, -1):
        got = column(spark, values, content.content_text(F.array("v"), limit))
        assert got == [v.strip()[:limit] if limit > 0 else v.strip() for v in values]
    joined = content.content_text(F.array(F.col("v"), F.lit("z")), -1)
    assert column(spark, ["a"], joined) == ["a\nz"]
    missing = content.content_text(F.lit(None).cast("array<string>"))
    assert column(spark, ["a"], missing) == [""]
    assert column(spark, values + [None], content.indexed_chars_of(F.col("v"))) == [
        *map(len, values), 0,
    ]


def test_content_type(spark):
    rows = [
        ({"Content-Type": ["text/html; charset=x"]}, None, "text/html"),
        ({"Content-Type": ["a/b", "c/d"]}, "", "a/b"),
        ({"Content-Type": ["a/b"]}, " e/f ;q", "e/f"),
        ({"Content-Type": []}, None, "application/octet-stream"),
        ({}, None, "application/octet-stream"),
    ]
    frame = spark.createDataFrame(
        [(m, d, w) for m, d, w in rows], "m map<string,array<string>>, d string, want string"
    )
    got = frame.select(content.content_type(F.col("m"), F.col("d")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


@pytest.mark.parametrize(
    "algorithm", ["MD5", "SHA-1", "sha-224", "SHA-256", "sha384", "SHA-512", "sha3_256", "blake2b"]
)
def test_checksums(spark, algorithm):
    data = [b"hello checksum", b"", None]
    name = algorithm.lower().replace("-", "")
    expected = [None if d is None else hashlib.new(name, d).hexdigest() for d in data]
    assert column(spark, data, hashing.checksum(F.col("v"), algorithm), "binary") == expected


def test_unknown_checksum_is_null_and_the_content_hash_falls_back(spark):
    for algorithm in ("nothing", "SHA3-256", None, ""):
        assert column(spark, [b"x"], hashing.checksum(F.col("v"), algorithm), "binary") == [None]
        assert column(spark, [b"x"], hashing.content_hash(F.col("v"), algorithm), "binary") == [
            hashlib.sha256(b"x").hexdigest()
        ]
    assert column(spark, [b"x"], hashing.content_hash(F.col("v"), "md5"), "binary") == [
        hashlib.md5(b"x").hexdigest()
    ]


def test_last_listed_key_wins(spark):
    rng = random.Random(3)
    samples = []
    for _ in range(200):
        keys = rng.sample(list(RAW_KEYS), rng.randint(0, 12)) + ["unknown"]
        samples.append({k: [f"{k}!", "second"] for k in keys})
    rows = [Row(i=i, m=m) for i, m in enumerate(samples)]
    frame = spark.createDataFrame(rows, "i int, m map<string,array<string>>")
    got = frame.select("i", metadata.meta_struct("m").alias("meta")).orderBy("i").collect()
    for sample, row in zip(samples, got):
        expected = {}
        for key, field in RAW_KEYS.items():
            if key in sample:
                expected[field] = f"{key}!"
        found = {} if row.meta is None else {k: v for k, v in row.meta.asDict().items() if v}
        assert found == expected
    assert set(RAW_KEYS.values()) == set(META_FIELDS)
    assert (len(RAW_KEYS), len(META_FIELDS)) == (37, 25)


def test_empty_list_falls_through(spark):
    frame = spark.createDataFrame([({"Author": [], "dc:creator": ["x"]},)], "m map<string,array<string>>")
    assert frame.select(metadata.meta_field("m", "author")).first()[0] == "x"


def test_typed_metadata(spark):
    dates = {
        "2024": datetime(2024, 1, 1), "2024-02": datetime(2024, 2, 1),
        "2024-02-03": datetime(2024, 2, 3), "2024-02-03T04": datetime(2024, 2, 3, 4),
        "2024-02-03T04:05": datetime(2024, 2, 3, 4, 5),
        "2024-02-03T04:05:06.5Z": datetime(2024, 2, 3, 4, 5, 6, 500000),
        "2024-02-03T04:05:06+0200": datetime(2024, 2, 3, 2, 5, 6),
        "2024-02-03T04:05:06+02": datetime(2024, 2, 3, 2, 5, 6),
        "2024-02-03T04:05:06-02:30": datetime(2024, 2, 3, 6, 35, 6),
        "not a date": None, "2024-13-01": None, "T04:05": None, " 2024": None, "2024-02-03 04:05": None,
    }
    micros = F.unix_micros(metadata.typed_date("v"))
    expected = [
        None if d is None else int(d.replace(tzinfo=timezone.utc).timestamp() * 1_000_000)
        for d in dates.values()
    ]
    for zone in ("America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert column(spark, list(dates), micros) == expected
    ratings = {"5": 5, "-1.9": -1, "3.7": 3, "high": None, "40000": None, "": None, "NaN": None}
    assert column(spark, list(ratings), metadata.typed_short("v")) == list(ratings.values())


def test_units(spark):
    durations = {
        "15m": 900.0, "500ms": 0.5, "2h": 7200.0, "1d": 86400.0, "5S": 5.0, "7": 7.0,
        " 1.5 h ": 5400.0, "badvalue": None, "": None, "-5s": None, "1w": None, "5 m s": None,
    }
    got = column(spark, list(durations), units.parse_duration(F.col("v"), "null"))
    assert got == list(durations.values())
    sizes = {
        "512mb": 536870912, "10KB": 10240, "1.5kb": 1536, "100b": 100, "1tb": 1024**4, "0": 0,
        "0.7": 0, "1pb": None, "mb": None, "99999999tb": None, "9" * 400: None,
    }
    got = column(spark, list(sizes), units.parse_byte_size(F.col("v"), "null"))
    assert got == list(sizes.values())
    chars = {"100000.0": 100000, "-1": -1, " 7 ": 7, "-1.9": -1, "1e3": 1000, ".5": 0, "x": None, "1d": None, "1e300": None}
    got = column(spark, list(chars), units.parse_indexed_chars(F.col("v"), "null"))
    assert got == list(chars.values())
    for parse in (units.parse_duration, units.parse_byte_size, units.parse_indexed_chars):
        assert column(spark, [None], parse(F.col("v"))) == [None]
        with pytest.raises(Exception, match="not a"):
            column(spark, ["bad"], parse(F.col("v")))


def test_iso_text_does_not_depend_on_the_session_zone(spark):
    micros = [0, -1, 1710054000_000000, 1710055800_000500, 1730620800_123456, -62135596800_000000]
    expected = [
        (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=m)).isoformat()
        for m in micros
    ]
    for zone in ("America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert column(spark, micros, render.iso_utc(F.timestamp_micros("v")), "bigint") == expected
    assert column(spark, [None], render.iso_utc(F.timestamp_micros("v")), "bigint") == [None]


def test_document_json(spark):
    moment = datetime(2024, 1, 2, 3, 4, 5, 67, tzinfo=timezone.utc)
    file = {
        "content_type": "text/plain", "filename": 'q"uote\n.txt', "extension": "txt",
        "filesize": 3, "indexed_chars": 4, "indexing_date": moment,
        "last_modified": moment.replace(microsecond=0), "created": None, "last_accessed": None,
        "checksum": None, "url": "",
    }
    path = {"real": "/d/é", "root": "/d", "virtual": "/é"}
    none = dict.fromkeys(META_FIELDS)
    docs = [
        (file, path, none | {"title": "", "author": "a"}, "text\u2028", b"x" * 100),
        (file, path, None, "", None),
        (None, path, None, None, None),
    ]
    schema = struct(i=T.IntegerType(), d=DOCUMENT)
    frame = spark.createDataFrame(list(enumerate(docs)), schema)
    got = [json.loads(r[0]) for r in frame.orderBy("i").select(render.document_json(F.col("d"))).collect()]
    plain = {k: v for k, v in file.items() if v is not None}
    plain["indexing_date"] = moment.isoformat()
    plain["last_modified"] = moment.replace(microsecond=0).isoformat()
    assert got[0] == {
        "file": plain, "path": path, "meta": {"author": "a", "title": ""}, "content": "text\u2028",
        "attachment": b64encode(b"x" * 100).decode(),
    }
    assert got[1] == {"file": plain, "path": path, "content": ""}
    assert got[2] == {"path": path}


def test_references_are_decoded_like_the_standard_library(spark):
    texts = [
        "a &amp; b", "&amp;lt;", "&copy;&middot;&nbsp;&eacute;", "&#233;&#xe9;&#XE9", "&notit;", "&notin;", "&amp", "&am",
        "&#128;", "&#0;", "&#xD800;", "&#99999999999999999999;", "&unknown; & &", "", "&NotEqualTilde;", "x&lt;y&gt;z&quot;", "&copyright",
    ]
    got = column(spark, texts, extract.unescaped(F.col("v")))
    assert got == [html.unescape(t) for t in texts]
