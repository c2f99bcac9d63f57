"""Frames the registered queries work on, derived from the shared tables.

The tables hold no file tree, so paths, times, metadata and events are computed from their
columns; every row of the tables takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsnap.schema import CONTENT_TYPE_KEY, RAW_KEYS
from docsnap.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, folder: str) -> DataFrame:
    return _files(table(spark, folder, "documents"))


def _files(rows: DataFrame, *more: str) -> DataFrame:
    return rows.selectExpr(
        "doc_id",
        """concat('/data/', source, '/', lang, '/doc_', cast(doc_id as string),
             case doc_id % 5 when 0 then '.txt' when 1 then '.pdf' when 2 then '.MD'
                             when 3 then '.tmp' else '' end) as path""",
        "cast(octet_length(text) as bigint) as length",
        "1700000000 + doc_id * 37 as mtime",
        "text",
        *more,
    )


def files_with_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The files and their raw metadata, from one scan."""
    rows = table(spark, folder, "documents").selectExpr("*", f"{raw_map()} as metadata")
    return _files(rows, "metadata")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """The files for steps that work hard on each text."""
    return spread(files(spark, folder), "doc_id")


def previous(spark: SparkSession, folder: str) -> DataFrame:
    now = files(spark, folder)
    kept = now.filter("doc_id % 10 <> 3").selectExpr(
        "path", "mtime - case when doc_id % 7 = 0 then 5 else 0 end as mtime"
    )
    gone = now.filter("doc_id % 10 = 7").selectExpr("concat(path, '.gone') as path", "mtime")
    return kept.unionByName(gone)


# Raw key -> the text it holds where it is set.
RAW_TEXTS = {
    "dc:creator": "case when doc_id % 2 = 0 then concat('creator ', cast(doc_id % 13 as string)) end",
    "Author": "case when doc_id % 3 = 0 then concat('author ', cast(doc_id % 11 as string)) end",
    "meta:author": "case when doc_id % 5 = 0 then concat('meta ', cast(doc_id % 7 as string)) end",
    "dc:date": "case doc_id % 4 when 0 then '2024-01-01T00:00:00Z' when 1 then 'not a date' end",
    "Last-Modified": "case when doc_id % 9 = 0 then '2023-05-06T07:08:09Z' end",
    "dc:title": "case when doc_id % 6 < 4 then concat('doc ', cast(doc_id as string)) end",
    "title": "case when doc_id % 8 = 3 then concat('page ', cast(doc_id as string)) end",
    "dc:language": "lang",
    "Content-Language": "case when doc_id % 12 = 5 then 'xx' end",
    CONTENT_TYPE_KEY: "case doc_id % 3 when 0 then 'text/html; charset=UTF-8' when 1 then 'application/pdf' end",
    "xmpMM:Rating": "case doc_id % 6 when 0 then '5' when 1 then 'high' end",
    "dcterms:modified": "case when n_chars % 10 = 3 then '2022-03-04T05:06:07Z' end",
    "meta:last-modified": "case when n_chars % 14 = 5 then '2022-07' end",
    "Last-Save-Date": "case when n_chars % 16 = 7 then 'yesterday' end",
    "Creation-Date": "case when n_chars % 5 = 1 then '2021-01-02' end",
    "created": "case when n_chars % 4 = 1 then '2021-02-03T04:05:06Z' end",
    "dcterms:created": "case when n_chars % 6 = 2 then '2020' end",
    "Print-Date": "case when n_chars % 7 = 1 then '2019-09-10' end",
    "meta:print-date": "case when n_chars % 9 = 2 then '2019-10-11T12:13Z' end",
    "xmp:MetadataDate": "case when n_chars % 11 = 3 then '2018' end",
}
# The other keys hold a text of their own for three documents in five.
RAW_TEXTS |= {
    key: f"case when (n_chars + {at}) % 5 < 3 then concat(source, ' {key} ', lang) end"
    for at, key in enumerate(RAW_KEYS)
    if key not in RAW_TEXTS
}


def raw_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id`` and the raw map; some keys hold an empty list, as an extractor may send."""
    return table(spark, folder, "documents").selectExpr("doc_id", f"{raw_map()} as metadata")


def raw_map() -> str:
    """The raw map of a row of ``documents`` as SQL."""
    entries = ", ".join(
        f"""case when ({text}) is not null then struct('{key}' as key, array({text}) as value)
             when doc_id % 17 = 4 then struct('{key}' as key, cast(array() as array<string>) as value) end"""
        for key, text in RAW_TEXTS.items()
    )
    return f"map_from_entries(array_compact(array({entries})))"


def events_from(rows: DataFrame) -> DataFrame:
    """File events from rows of the event table; works on a stream as well."""
    return rows.selectExpr(
        "event_id",
        "cast(ts as timestamp_ntz) as ts",
        """case event_type when 'signup' then 'created' when 'error' then 'deleted'
             else 'modified' end as kind""",
        """concat('/data/u', cast(user_id as string),
             case event_id % 4 when 0 then '.pdf' when 1 then '.txt' when 2 then '.tmp'
                               else '' end) as src_path""",
        "event_id % 9 = 0 as is_directory",
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return events_from(table(spark, folder, "events"))


def pauses(spark: SparkSession, folder: str) -> DataFrame:
    """Pauses of some minutes from the first event of each user on; many overlap."""
    return (
        table(spark, folder, "events")
        .groupBy("user_id")
        .agg(F.min("ts").cast("timestamp_ntz").alias("start_ts"))
        .selectExpr("start_ts", "start_ts + interval 20 minutes as end_ts")
    )


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(
        "doc_id as upload_id",
        "concat('up_', cast(doc_id % 400 as string), '.txt') as filename",
        "case when doc_id % 3 = 0 then 'text/plain; charset=utf-8' end as content_type",
        """case when doc_id % 4 = 0 then concat('id-', cast(doc_id as string))
                when doc_id % 8 = 2 then '' end as doc_id""",
        "case when doc_id % 6 = 0 then 'other_docs' end as index",
        "doc_id % 10 = 0 as simulate",
        "doc_id % 14 = 0 as debug",
        "cast(text as binary) as data",
    )


def delete_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Deletions by file name and by id, some of them repeated."""
    return uploads(spark, folder).selectExpr(
        "coalesce(nullif(doc_id, ''), filename) as key", "index"
    )
