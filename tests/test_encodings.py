"""Decoding next to Python's own codecs, with marks, labels, and without a hint."""

import pytest
from pyspark.sql import functions as F

from docsnap.operators import encodings
from docsnap.operators.extract import decoded_html, default_extractor

TEXTS = {
    "cp932": "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
    "euc_jp": "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
    "gb18030": "今天天气很好，我们一起去公园散步吧。中国的首都是北京。",
    "big5hkscs": "今天天氣很好，我們一起去公園散步吧。臺灣的首都是臺北。",
    "cp949": "나는 학교에 갑니다. 오늘은 날씨가 매우 좋습니다. 그리고 우리는 공원에 갔다.",
    "cp1251": "Мой дядя самых честных правил, когда не в шутку занемог, он уважать себя заставил.",
    "koi8_r": "Мой дядя самых честных правил, когда не в шутку занемог, он уважать себя заставил.",
    "cp1252": "Où est le garçon qui a mangé la crème brûlée à l’hôtel ? Straße, größer, señor.",
    "utf-8": "Où est le garçon? Мой дядя. 吾輩は猫である。 나는 학교에 갑니다.",
}


def pages():
    for codec, text in TEXTS.items():
        yield codec, text.encode(codec), text, None
        yield f"{codec} within markup", f"<html><title>A page</title> {text} plain ascii words</html>".encode(codec), f"<html><title>A page</title> {text} plain ascii words</html>", None
    for codec in ("utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be", "utf-8"):
        for text in (TEXTS["cp932"], TEXTS["cp1251"], "plain"):
            yield f"{codec} marked", ("﻿" + text).encode(codec), text, "shift_jis"
    for codec in ("utf-16-le", "utf-16-be"):
        yield codec, TEXTS["cp1252"].encode(codec), TEXTS["cp1252"], None
    for label, codec in (("Shift_JIS", "cp932"), ("gb2312", "gb18030"), ("windows-1251", "cp1251"), ("iso-8859-1", "cp1252"), ("Big5", "big5hkscs"), ("EUC-KR", "cp949"), ("koi8-r", "koi8_r")):
        yield f"label {label}", TEXTS[codec].encode(codec)[:30], TEXTS[codec].encode(codec)[:30].decode(codec, "replace"), label
    yield "label iso-2022-jp", TEXTS["cp932"].encode("iso2022_jp"), TEXTS["cp932"], "iso-2022-jp"
    yield "label windows-1257", "Žąsis lėtai".encode("cp1257"), "Žąsis lėtai", "windows-1257"
    yield "unknown label", TEXTS["utf-8"].encode(), TEXTS["utf-8"], "x-nothing"
    yield "a codec that is none of text", TEXTS["utf-8"].encode(), TEXTS["utf-8"], "base64"
    yield "ascii", b"plain words", "plain words", "euc-kr"
    yield "nothing", b"", "", None
    yield "some malformed bytes", b" caf\xc3\xa9 \xff ", " café � ", None
    yield "control codes of the Web", b"a\x81\x80b\xe9", "a\x81€bé", "latin1"


def test_like_python(spark):
    cases = list(pages())
    rows = spark.createDataFrame([(k, c[1], c[3]) for k, c in enumerate(cases)], "k int, data binary, label string")
    found = rows.select("k", encodings.decoded(F.col("data"), F.col("label")).alias("text")).collect()
    assert {cases[r.k][0]: r.text for r in found} == {c[0]: c[2] for c in cases}
    assert spark.createDataFrame([(None,)], "data binary").select(encodings.decoded(F.col("data"))).first()[0] is None


def test_utf8_rows_stay_in_the_jvm(spark, monkeypatch):
    rows = spark.createDataFrame([(b"plain",), (TEXTS["utf-8"].encode(),)], "data binary")
    text = encodings.decoded(F.col("data"))
    seen = rows.select(F.when(F.is_valid_utf8(F.col("data").cast("string")), text)).collect()
    assert [r[0] for r in seen] == ["plain", TEXTS["utf-8"]]


@pytest.mark.parametrize("codec", ["cp932", "gb18030", "cp1251", "big5hkscs"])
def test_pages_with_a_label(spark, codec):
    page = f"<html><head><meta http-equiv=Content-Type content='text/html; charset={codec.replace('cp1251', 'windows-1251').replace('cp932', 'shift_jis').replace('hkscs', '')}'></head>{TEXTS[codec]}</html>"
    rows = spark.createDataFrame([("/p.html", page.encode(codec))], "path string, data binary")
    assert rows.select(decoded_html(F.col("data"))).first()[0] == page
    assert TEXTS[codec] in default_extractor(rows).first().text[0]
