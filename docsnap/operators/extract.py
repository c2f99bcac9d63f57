"""Bytes to text and metadata.

An extractor takes a frame with a ``data`` column and adds ``metadata``
(``map<string, array<string>>``), ``text`` (``array<string>``) and ``error``. The built-in
ones are column expressions; ``PythonExtractor`` wraps a function on bytes.
"""

from __future__ import annotations

import json
import signal
import threading
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from html.entities import html5
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsnap.functions.names import extension, file_name
from docsnap.operators.encodings import decoded
from docsnap.operators.isolated import Child
from docsnap.schema import CONTENT_TYPE_KEY, EXTRACTED, RAW_METADATA, TEXT_KEY

Extractor = Callable[[DataFrame], DataFrame]

def _plain_metadata() -> Column:
    return F.create_map(F.lit(CONTENT_TYPE_KEY), F.array(F.lit("text/plain"))).cast(RAW_METADATA)


# The characters that the Western single-byte encoding has where Latin-1 has control codes.
_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
_WESTERN_MARKS = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def decoded_html(data: Column) -> Column:
    """The page in the encoding its first kilobyte declares, or in which it is found to be."""
    head = F.decode(F.substring(data, 1, 1024), "ISO-8859-1")
    declared = F.regexp_extract(head, r"""(?is)<meta\b[^>]*?charset\s*=\s*["']?\s*([a-z0-9_-]+)""", 1)
    return decoded(data, declared)


# The names are those of the standard library; legacy ones also count without a semicolon.
_NAMED = json.dumps({f"&{name}": character for name, character in html5.items()})
_LEGACY = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"


def _character(reference: Column) -> Column:
    """What one character reference stands for; itself where it is none."""
    named = F.from_json(F.lit(_NAMED), "map<string,string>")
    start = F.regexp_extract(reference, rf"\A&(?:{_LEGACY})", 0)
    digits = F.regexp_extract(reference, r"\A&#([0-9]+)", 1)
    code = F.when(digits != "", F.coalesce(digits.try_cast("bigint"), F.lit(-1))).otherwise(
        F.conv(F.regexp_extract(reference, r"\A&#[xX]([0-9a-fA-F]+)", 1), 16, 10).try_cast("bigint")
    )
    bad = code.isNull() | (code <= 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    known = F.when(bad, 0xFFFD).otherwise(code)
    character = F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32")
    return F.when(F.startswith(reference, F.lit("&#")), F.translate(character, _CONTROLS, _WESTERN_MARKS)).otherwise(
        F.coalesce(
            F.element_at(named, reference),
            F.when(start != "", F.concat(F.element_at(named, start), F.substr(reference, F.length(start) + 1))),
            reference,
        )
    )


def unescaped(text: Column) -> Column:
    """All named and numeric character references of HTML, each decoded once."""
    references = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    between = F.split(text, _REFERENCE, -1)
    pairs = F.zip_with(between, references, lambda t, r: F.concat(t, F.when(r.isNotNull(), _character(r)).otherwise("")))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pairs, "")).otherwise(text)


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x{a0}]+", " "))


def _first_group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def html_title(html: Column) -> Column:
    """Text of the first title element with white space collapsed; null without one."""
    return F.nullif(_one_line(unescaped(_raw_title(html))), F.lit(""))


def _raw_title(html: Column) -> Column:
    return _first_group(html, r"(?is)<title[^>]*>(.*?)</title\s*>")


def html_language(html: Column) -> Column:
    """The ``lang`` attribute of the root element; null without one."""
    return _first_group(html, r"""(?is)<html[^>]*?\slang\s*=\s*["']?([a-z0-9-]+)""")


def html_text(html: Column) -> Column:
    """The text between tags, without scripts, styles and comments; an unclosed one of these
    takes the rest of the page."""
    bare = F.regexp_replace(
        html, r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)", " "
    )
    return _one_line(unescaped(F.regexp_replace(bare, r"<[^>]*>", " ")))


# Names of <meta> tags that stand for a raw metadata key; others keep their name.
_META_NAMES = {
    "author": "Author", "keywords": "Keywords", "description": "dc:description", "title": "title",
    "date": "dc:date", "language": "dc:language", "og:title": "dc:title", "og:description": "dc:description",
}


def html_metadata(html: Column) -> Column:
    """Raw metadata of a page: type, title, language, then its named ``<meta>`` tags.

    Of entries with one key the first with a text counts.
    """
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))

    def attribute(tag: Column, names: str) -> Column:
        pattern = rf"""(?is)\s(?:{names})\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
        return F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))

    def entry(tag: Column) -> Column:
        name = attribute(tag, "name|property")
        known = F.lower(name)
        # dc.title and dcterms.created are the same names with another mark.
        key = F.regexp_replace(name, r"(?i)\A(dc|dcterms)\.", "$1:")
        for plain, raw in _META_NAMES.items():
            key = F.when(known == plain, raw).otherwise(key)
        return F.struct(key.alias("key"), attribute(tag, "content").alias("value"))

    fixed = {CONTENT_TYPE_KEY: F.lit("text/html"), "dc:title": _raw_title(html), "dc:language": html_language(html)}
    own = F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(v, F.lit("")).alias("value")) for k, v in fixed.items()))
    entries = F.filter(F.concat(own, F.transform(tags, entry)), lambda e: (e["key"] != "") & (F.trim(e["value"]) != ""))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))

    def first(key: Column) -> Column:
        return F.get(F.transform(F.filter(entries, lambda e: e["key"] == key), lambda e: e["value"]), F.lit(0))

    named = F.map_from_arrays(keys, F.transform(keys, lambda k: F.array(_one_line(unescaped(first(k))))))
    return F.map_filter(named, lambda _, v: F.get(v, F.lit(0)) != "").cast(RAW_METADATA)


def text_extractor(files: DataFrame) -> DataFrame:
    return files.select(
        "*",
        _plain_metadata().alias("metadata"),
        F.array(decoded(F.col("data"))).alias("text"),
        F.lit(None).cast("string").alias("error"),
    )


def html_extractor(files: DataFrame) -> DataFrame:
    html = F.col("_html")
    return files.withColumn("_html", decoded_html(F.col("data"))).select(
        *files.columns,
        html_metadata(html).alias("metadata"),
        F.array(html_text(html)).alias("text"),
        F.lit(None).cast("string").alias("error"),
    )


def default_extractor(files: DataFrame) -> DataFrame:
    """HTML by file extension, everything else as text; ``path`` decides."""
    is_html = extension(file_name(F.col("path"))).isin("html", "htm", "xhtml")
    html, plain = F.col("_html"), F.col("_plain")
    read = files.withColumns(
        {"_html": decoded_html(F.when(is_html, F.col("data"))), "_plain": decoded(F.when(~is_html, F.col("data")))}
    )
    return read.select(
        *files.columns,
        F.when(is_html, html_metadata(html)).otherwise(_plain_metadata()).alias("metadata"),
        F.array(F.when(is_html, html_text(html)).otherwise(plain)).alias("text"),
        F.lit(None).cast("string").alias("error"),
    )


@contextmanager
def _deadline(seconds: float | None) -> Iterator[None]:
    """Interrupts Python code that runs too long; only possible in a main thread."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def expire(*_: Any) -> None:
        raise TimeoutError(f"extraction took longer than {seconds} s")

    before = signal.signal(signal.SIGALRM, expire)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


class PythonExtractor:
    """An extractor from a function ``bytes -> mapping``.

    The mapping holds raw keys with a text or a list of texts; the content sits under
    ``schema.TEXT_KEY``. Of a list of mappings the first counts. A failure becomes the row's
    error and leaves the other rows alone. ``isolated`` runs the function in a process of its own, which
    is killed at the time limit and may take ``memory_limit`` bytes: that stops native code too.
    """

    def __init__(
        self,
        function: Callable[[bytes], Mapping[str, Any] | list[Mapping[str, Any]]],
        time_limit: float | None = None,
        isolated: bool = False,
        memory_limit: int | None = None,
    ) -> None:
        self.function = function
        self.time_limit = time_limit
        self.isolated = isolated or memory_limit is not None
        self.memory_limit = memory_limit
        self._child: Child | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_child": None}

    def _found(self, data: bytes) -> Any:
        if not self.isolated:
            with _deadline(self.time_limit):
                return self.function(data)
        if self._child is None:
            self._child = Child(self.function, self.time_limit, self.memory_limit)
        return self._child.call(data)

    def close(self) -> None:
        """Ends the process of an isolated extractor; the next call starts another."""
        if self._child is not None:
            self._child.end()

    def one(self, data: bytes) -> tuple[dict | None, list | None, str | None]:
        try:
            found = self._found(data)
            if isinstance(found, list):
                found = found[0] if found else {}
            raw = {
                str(key): [str(v) for v in value] if isinstance(value, (list, tuple)) else [str(value)]
                for key, value in found.items()
                if value is not None
            }
            return raw, raw.pop(TEXT_KEY, None), None
        except Exception as problem:  # noqa: BLE001 - the row carries it on
            return None, None, f"{type(problem).__name__}: {problem}"

    def __call__(self, files: DataFrame) -> DataFrame:
        one, close = self.one, self.close

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = [one(bytes(data)) for data in frame["data"]]
                for at, name in enumerate(EXTRACTED.fieldNames()):
                    frame[name] = pd.Series([r[at] for r in rows], index=frame.index, dtype=object)
                yield frame
            close()

        return files.mapInPandas(batches, T.StructType(files.schema.fields + EXTRACTED.fields))
