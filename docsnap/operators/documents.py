"""File rows with extracted text and metadata to nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsnap.functions.content import content_text, content_type, indexed_chars_of
from docsnap.functions.hashing import checksum, content_hash, path_id
from docsnap.functions.metadata import meta_struct
from docsnap.functions.names import extension, file_name
from docsnap.functions.paths import path_struct
from docsnap.options import CrawlOptions
from docsnap.schema import DOCUMENT


def _text(options: CrawlOptions) -> Column:
    if not options.index_content:
        return F.lit(None).cast("string")
    return content_text(F.col("text"), options.indexed_chars)


def _checksum(options: CrawlOptions) -> Column:
    if options.id_mode == "content":
        return content_hash(F.col("data"), options.checksum)
    return checksum(F.col("data"), options.checksum)


def _moment(files: DataFrame, column: str) -> Column:
    return (F.col(column) if column in files.columns else F.lit(None)).cast("timestamp")


def with_document(files: DataFrame, options: CrawlOptions, indexed_at: Column) -> DataFrame:
    """Add ``_id`` and ``doc`` to rows with path, length, mtime, text and metadata.

    ``data`` is needed only where ``options.needs_bytes``; ``indexed_at`` is one moment per
    run, so that a repeated run writes the same documents.
    """
    content = _text(options)
    name = file_name(F.col("path"))
    raw = F.col("data") if options.store_source else F.lit(None).cast("binary")
    doc = F.struct(
        F.struct(
            content_type(F.col("metadata")).alias("content_type"),
            name.alias("filename"),
            extension(name).alias("extension"),
            F.col("length").cast("bigint").alias("filesize"),
            indexed_chars_of(content).alias("indexed_chars"),
            indexed_at.alias("indexing_date"),
            _moment(files, "mtime").alias("last_modified"),
            _moment(files, "birthtime").alias("created"),
            _moment(files, "atime").alias("last_accessed"),
            _checksum(options).alias("checksum"),
            F.col("path").alias("url"),
        ).alias("file"),
        path_struct(F.col("path"), options.root).alias("path"),
        meta_struct("metadata").alias("meta"),
        content.alias("content"),
        raw.alias("attachment"),
    ).cast(DOCUMENT)
    if options.id_mode == "content":
        return files.withColumn("doc", doc).withColumn("_id", F.col("doc.file.checksum"))
    return files.withColumn("doc", doc).withColumn("_id", path_id(F.col("path"), options.id_mode))


def with_upload_document(
    uploads: DataFrame, options: CrawlOptions, indexed_at: Column
) -> DataFrame:
    """Add ``_id``, ``_index``, ``url`` and ``doc`` to rows with filename, data, content_type,
    doc_id, index, text and metadata.

    An upload has no file times but its arrival, no url inside the document, no attachment,
    and is known by its given id or its file name whatever the id mode.
    """
    content = _text(options)
    name = file_name(F.col("filename"))
    given_id = F.coalesce(F.nullif(F.col("doc_id"), F.lit("")), F.col("filename"))
    index = F.coalesce(F.nullif(F.col("index"), F.lit("")), F.lit(options.index))
    nothing = F.lit(None)
    doc = F.struct(
        F.struct(
            content_type(F.col("metadata"), F.col("content_type")).alias("content_type"),
            name.alias("filename"),
            extension(name).alias("extension"),
            F.octet_length("data").cast("bigint").alias("filesize"),
            indexed_chars_of(content).alias("indexed_chars"),
            indexed_at.alias("indexing_date"),
            indexed_at.alias("last_modified"),
            nothing.alias("created"),
            nothing.alias("last_accessed"),
            _checksum(options).alias("checksum"),
            F.lit("").alias("url"),
        ).alias("file"),
        F.struct(
            F.col("filename").alias("real"),
            F.lit(options.root).alias("root"),
            F.concat(F.lit("/"), name).alias("virtual"),
        ).alias("path"),
        meta_struct("metadata").alias("meta"),
        content.alias("content"),
        nothing.alias("attachment"),
    ).cast(DOCUMENT)
    return (
        uploads.withColumn("doc", doc)
        .withColumn("_id", given_id)
        .withColumn("_index", index)
        .withColumn("url", F.format_string("/%s/_doc/%s", "_index", "_id"))
    )
