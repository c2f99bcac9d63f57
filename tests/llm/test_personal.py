"""Personal data against whole regular expressions."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from docsnap.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def right(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(p) <= 255 for p in text.split(".")),
        "card": 12 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def brute(text):
    found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if right(k, m[0])]
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def base(text):
    return [s for s in personal.Parsers().spans(text) if s[0] in personal.BASE]


PIECES = [
    "a.b@c-d.ef", "@", "x@y", ".", "-", " ", "+1 (555) 010-9999", "+49", "10.0.0.1", "1.2.3.4.5.6.7.8", "300.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "007.08.9.1", "é", "\n", "12", "  ", "word", "_%+", "a@b.c@d.e", "٣",
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_like_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@+- 52", max_size=60))
def test_like_patterns_on_noise(text):
    assert base(text) == brute(text)


def test_added_spans_leave_the_base_alone():
    text = "See https://x.org/a?b=1. IBAN: DE89 3704 0044 0532 0130 00, account no 12-345678; passport X1234567 me@x.org"
    spans = personal.Parsers().spans(text)
    shown = {(k, text[a:b]) for k, a, b in spans}
    assert {("url", "https://x.org/a?b=1"), ("iban", "DE89 3704 0044 0532 0130 00"), ("account", "12-345678"),
            ("account", "X1234567"), ("email", "me@x.org")} <= shown
    assert [s for s in spans if s[0] in personal.BASE] == brute(text)
    assert not [s for s in personal.Parsers().spans("the account is closed, rebiban DE1") if s[0] not in personal.BASE]


def test_table(spark):
    rng = random.Random(0)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randrange(30)))) for i in range(80)]
    rows += [(90, None), (91, ""), (None, "a@b.cd"), (92, "1" * 3_000), (93, "a" * 200_000 + "@"), (93, "a@b.cd")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    expected = []
    for doc_id, text in rows:
        spans = brute(text or "") if doc_id != 93 or len(text) < 100 else []
        shown = personal.joined(spans)
        counts = [sum(s[0] == k for s in spans) for k in personal.BASE]
        expected.append((doc_id, *counts, hashlib.sha256(shown.encode()).hexdigest()))
    found = [tuple(r)[:6] for r in personal.personal_data(df).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert personal.personal_data(df.limit(0)).collect() == []
