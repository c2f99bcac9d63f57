"""Schemas of the tables and the table of raw metadata keys."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw extractor key -> document field. Where several keys feed one field, the
# key listed last wins.
RAW_KEYS = {
    "dc:creator": "author",
    "Author": "author",
    "meta:author": "author",
    "dc:title": "title",
    "title": "title",
    "Creation-Date": "created",
    "created": "created",
    "dcterms:created": "created",
    "dc:date": "date",
    "dcterms:modified": "date",
    "Last-Modified": "date",
    "meta:last-modified": "date",
    "Last-Save-Date": "date",
    "Keywords": "keywords",
    "meta:keyword": "keywords",
    "dc:language": "language",
    "Content-Language": "language",
    "dc:format": "format",
    "dc:identifier": "identifier",
    "dc:contributor": "contributor",
    "dc:coverage": "coverage",
    "meta:last-author": "modifier",
    "xmp:CreatorTool": "creator_tool",
    "dc:publisher": "publisher",
    "dc:relation": "relation",
    "dc:rights": "rights",
    "dc:source": "source",
    "dc:type": "type",
    "dc:description": "description",
    "Print-Date": "print_date",
    "meta:print-date": "print_date",
    "xmp:MetadataDate": "metadata_date",
    "geo:lat": "latitude",
    "geo:long": "longitude",
    "geo:alt": "altitude",
    "xmpMM:Rating": "rating",
    "usercomment": "comments",
}

# Raw keys with a role of their own.
CONTENT_TYPE_KEY = "Content-Type"
TEXT_KEY = "X-TIKA:content"
DEFAULT_CONTENT_TYPE = "application/octet-stream"

# Document metadata fields.
META_FIELDS = (
    "author", "date", "keywords", "title", "language", "format", "identifier",
    "contributor", "coverage", "modifier", "creator_tool", "publisher", "relation",
    "rights", "source", "type", "description", "created", "print_date", "metadata_date",
    "latitude", "longitude", "altitude", "rating", "comments",
)
META_DATES = ("date", "created", "print_date", "metadata_date")

STRINGS = T.ArrayType(T.StringType())
RAW_METADATA = T.MapType(T.StringType(), STRINGS)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _LONG, _DOUBLE, _FLAG = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_MOMENT = T.TimestampType()

NAMES = struct(path=_TEXT, is_dir=_FLAG, is_symlink=_FLAG, lineage=STRINGS, error=_TEXT)
# A row with ``todo`` is a directory that is still to be listed.
LISTED = struct(path=_TEXT, is_dir=_FLAG, length=_LONG, mtime=_DOUBLE, error=_TEXT, todo=STRINGS)
STATS = struct(length=_LONG, mtime=_DOUBLE, atime=_DOUBLE, birthtime=_DOUBLE)
EXTRACTED = struct(metadata=RAW_METADATA, text=STRINGS, error=_TEXT)
SNAPSHOT = struct(path=_TEXT, mtime=_DOUBLE)
COMMITS = struct(
    source=_TEXT, batch_id=_LONG, kind=_TEXT, job=_TEXT, started=T.TimestampNTZType(), covers=T.ArrayType(_LONG),
    buckets=_LONG, pieces=T.ArrayType(_LONG), since=T.ArrayType(_LONG), rows=T.ArrayType(_LONG),
    dead=T.ArrayType(_LONG),
)

# Fields of a document.
FILE = struct(
    content_type=_TEXT, filename=_TEXT, extension=_TEXT, filesize=_LONG, indexed_chars=_LONG,
    indexing_date=_MOMENT, last_modified=_MOMENT, created=_MOMENT, last_accessed=_MOMENT,
    checksum=_TEXT, url=_TEXT,
)
PATH = struct(real=_TEXT, root=_TEXT, virtual=_TEXT)
META = T.StructType([T.StructField(name, T.StringType()) for name in META_FIELDS])

DOCUMENT = struct(
    file=FILE, path=PATH, meta=META, content=_TEXT, attachment=T.BinaryType()
)

OPS = struct(
    phase=T.IntegerType(), ord=STRINGS, op=_TEXT, _index=_TEXT, _id=_TEXT, path=_TEXT,
    error=_TEXT, doc=DOCUMENT,
)

# A row of a compacted state keeps the run it came from.
STATE = T.StructType([*OPS.fields, T.StructField("of_run", T.LongType())])

# Keys of stored rows that a later piece of the state has replaced or deleted, and deletions that an older
# operation may still meet.
DEAD = struct(_index=_TEXT, _id=_TEXT)
TOMBS = struct(_index=_TEXT, _id=_TEXT, of_run=_LONG, phase=T.IntegerType(), ord=STRINGS)

RESPONSES = struct(
    upload_id=_LONG, filename=_TEXT, ok=_FLAG, error=_TEXT, url=_TEXT, doc=DOCUMENT
)

# Phases of one pass, in the order the operations apply.
PHASE_FOLDER, PHASE_FILE, PHASE_DELETE = 0, 1, 2

EVENTS = struct(
    event_id=_LONG, ts=T.TimestampNTZType(), kind=_TEXT, src_path=_TEXT, is_directory=_FLAG
)
