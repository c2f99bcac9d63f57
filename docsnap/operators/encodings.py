"""Text of bytes whose encoding is marked, declared, or has to be found out.

What begins with a byte-order mark is what that says, and a declared label counts if it is known. Else
bytes that are valid UTF-8 are that; they never leave the JVM. Others go to Python in Arrow batches, and
each candidate encoding is judged by its byte pairs: whether they follow its rules from beginning to end,
and how many of those beyond ASCII are usual ones, such as kana, frequent ideographs, syllables of
Korean, or Cyrillic letters in words of mostly small ones. A few malformed bytes among valid UTF-8
become replacement characters.
"""

from __future__ import annotations

import codecs
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels that mean another encoding on the Web than their name says.
WEB_LABELS = {
    "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "latin1": "cp1252", "l1": "cp1252", "us-ascii": "cp1252",
    "ascii": "cp1252", "x-cp1252": "cp1252", "iso-8859-9": "cp1254", "iso-8859-11": "cp874", "tis-620": "cp874",
    "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932",
    "gb2312": "gb18030", "gbk": "gb18030", "x-gbk": "gb18030", "chinese": "gb18030", "big5": "big5hkscs",
    "x-x-big5": "big5hkscs", "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "korean": "cp949", "x-euc-jp": "euc_jp",
    "macintosh": "mac_roman", "x-mac-cyrillic": "mac_cyrillic", "unicode": "utf-16-le", "utf-16": "utf-16-le",
}

# Marks at the beginning, the longer first.
MARKS = (
    (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"),
    (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"),
)

# First and last of usual lead and trail bytes of an encoding's characters.
USUAL = {
    "cp932": ((0x81, 0x81, 0x41, 0x5C), (0x82, 0x82, 0x9F, 0xF1), (0x83, 0x83, 0x40, 0x96), (0x88, 0x97, 0x40, 0xFC)),
    "euc_jp": ((0xA1, 0xA1, 0xA2, 0xBD), (0xA4, 0xA4, 0xA1, 0xF3), (0xA5, 0xA5, 0xA1, 0xF6), (0xB0, 0xCF, 0xA1, 0xFE)),
    "gb18030": ((0xA1, 0xA1, 0xA2, 0xBF), (0xA3, 0xA3, 0xA1, 0xFE), (0xB0, 0xD7, 0xA1, 0xFE)),
    "big5hkscs": ((0xA1, 0xA1, 0x40, 0x7E), (0xA4, 0xC6, 0x40, 0xFE)),
    "cp949": ((0xA1, 0xA1, 0xA2, 0xBF), (0xB0, 0xC8, 0xA1, 0xFE)),
}
KANA = {"cp932": ((0x82, 0x82, 0x9F, 0xF1), (0x83, 0x83, 0x40, 0x96)), "euc_jp": ((0xA4, 0xA5, 0xA1, 0xF6),)}
CYRILLIC = ("cp1251", "koi8_r")
FALLBACK = "cp1252"


def codec_of(label: str | None) -> str | None:
    """The Python codec of a declared label, if there is one for text."""
    label = (label or "").strip().lower()
    name = WEB_LABELS.get(label, label)
    try:
        found = codecs.lookup(name)
    except LookupError:
        return None
    return found.name if getattr(found, "_is_text_encoding", False) else None


def decoded_as(data: bytes, codec: str) -> str:
    if codec == "cp1252":
        # The Web keeps bytes without a character as control codes.
        return "".join(map(_WESTERN.__getitem__, data)) if not data.isascii() else data.decode("ascii")
    return data.decode(codec, "replace")


_WESTERN = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256)]


def _share(pairs: np.ndarray, ranges: tuple) -> float:
    lead, trail = pairs[:, 0], pairs[:, 1]
    usual = np.zeros(len(pairs), bool)
    for first, last, low, high in ranges:
        usual |= (lead >= first) & (lead <= last) & (trail >= low) & (trail <= high)
    return float(usual.mean())


def _pairs_score(data: bytes, codec: str) -> float:
    """How usual the byte pairs are; negative where the bytes break the rules."""
    try:
        text = data.decode(codec)
    except UnicodeDecodeError:
        return -1
    wide = re.sub(r"[\x00-\x7f｡-ﾟ]+", "", text)
    raw = wide.encode(codec, "ignore")
    if not wide or len(raw) != 2 * len(wide):
        return -1
    pairs = np.frombuffer(raw, np.uint8).reshape(-1, 2)
    score = _share(pairs, USUAL[codec])
    if codec in KANA:
        # Japanese is never without kana for long.
        return score * min(1.0, 0.4 + 3 * _share(pairs, KANA[codec]))
    if codec == "cp949":
        # Korean words have blanks between them; without, the same bytes are Chinese.
        return score * min(1.0, 0.3 + 8 * text.count(" ") / len(wide))
    return score * 0.97


def _letters_score(data: bytes, codec: str) -> float:
    """How much of what is beyond ASCII is Cyrillic words of small letters."""
    text = data.decode(codec, "replace")
    wide = re.sub(r"[\x00-\x7f]+", "", text)
    words = re.findall(r"[Ѐ-ӿ]{2,}", text)
    letters = "".join(words)
    if not letters:
        return 0
    small = sum(1 for c in letters if c.islower()) / len(letters)
    return len(letters) / len(wide) * small


def _western_score(data: bytes) -> float:
    """High bytes that stand alone among ASCII letters are accents."""
    high = np.frombuffer(data, np.uint8) >= 0x80
    runs = np.count_nonzero(high[1:] & ~high[:-1]) + int(high[0])
    return float(runs / high.sum()) * 0.75


def detected(data: bytes) -> str | None:
    """The codec of bytes without mark or label; none where they are UTF-8, but for a few bytes."""
    zeros = np.flatnonzero(np.frombuffer(data, np.uint8) == 0)
    if len(zeros) * 5 > len(data) and len(data) % 2 == 0:
        odd = int((zeros & 1).sum())
        if odd > 0.8 * len(zeros) or odd < 0.2 * len(zeros):
            return "utf-16-le" if odd > 0.8 * len(zeros) else "utf-16-be"
    text = data.decode("utf-8", "replace")
    bad = text.count("�")
    if sum(map(len, re.findall(r"[^\x00-\x7f�]+", text))) >= bad:
        return None
    scores = {codec: _pairs_score(data, codec) for codec in USUAL}
    scores |= {codec: _letters_score(data, codec) for codec in CYRILLIC}
    scores[FALLBACK] = _western_score(data)
    return max(scores, key=scores.__getitem__)


def text_of(data: bytes, label: str | None = None) -> str | None:
    """The text, or nothing where it is UTF-8 and may be taken as it is."""
    for mark, codec in MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(codec, "replace")
    codec = codec_of(label) or detected(data)
    return None if codec in (None, "utf-8") else decoded_as(data, codec)


def _texts(data: pd.Series, label: pd.Series) -> pd.Series:
    return pd.Series(
        [None if raw is None else text_of(bytes(raw), given) for raw, given in zip(data, label, strict=True)], dtype=object
    )


def decoded(data: Column, label: Column | None = None) -> Column:
    """The text of bytes; ``label`` is the encoding that is declared for them, if any."""
    text = data.cast("string")
    label = F.lit(None).cast("string") if label is None else F.nullif(F.lower(label), F.lit(""))
    marked = F.startswith(data, F.unhex(F.lit("EFBBBF")))
    plain = F.is_valid_utf8(text) & ~F.contains(text, F.lit("\0")) & ~marked
    # Where ASCII alone is used, hardly any label makes a difference.
    usual = label.isNull() | label.isin("utf-8", "utf8") | (~text.rlike(r"[^\x01-\x7f]") & ~F.startswith(label, F.lit("iso-2022")))
    found = F.pandas_udf(_texts, T.StringType())(F.when(~(plain & usual), data), label)
    return F.coalesce(found, F.make_valid_utf8(text))
