"""Index and delete operations of one run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsnap.functions.hashing import path_id
from docsnap.functions.paths import walk_order
from docsnap.functions.render import action_json, document_json
from docsnap.operators.batches import bulk_batches
from docsnap.operators.folders import folder_documents
from docsnap.options import CrawlOptions
from docsnap.schema import OPS, PHASE_DELETE, PHASE_FILE, PHASE_FOLDER


def file_ops(documents: DataFrame, options: CrawlOptions) -> DataFrame:
    """``index`` rows; a row with an ``error`` becomes an ``error`` row without a document."""
    failed = F.col("error").isNotNull()
    return documents.select(
        F.lit(PHASE_FILE).alias("phase"),
        walk_order(F.col("path")).alias("ord"),
        F.when(failed, "error").otherwise("index").alias("op"),
        F.lit(options.index).alias("_index"),
        F.when(~failed, F.col("_id")).alias("_id"),
        "path",
        "error",
        F.when(~failed, F.col("doc")).alias("doc"),
    ).to(OPS)


def folder_ops(folders: DataFrame, options: CrawlOptions) -> DataFrame:
    """``index`` rows of documents that have only a path."""
    return folder_documents(folders, options.root).select(
        F.lit(PHASE_FOLDER).alias("phase"),
        walk_order(F.col("_id")).alias("ord"),
        F.lit("index").alias("op"),
        F.lit(options.folder_index).alias("_index"),
        "_id",
        F.col("_id").alias("path"),
        F.struct(F.col("path_info").alias("path")).alias("doc"),
    ).to(OPS)


def _deletes(rows: DataFrame, index: Column, doc_id: Column) -> DataFrame:
    return rows.select(
        F.lit(PHASE_DELETE).alias("phase"),
        walk_order(F.col("path")).alias("ord"),
        F.lit("delete").alias("op"),
        index.alias("_index"),
        doc_id.alias("_id"),
        "path",
    ).to(OPS)


def delete_ops(deleted: DataFrame, options: CrawlOptions) -> DataFrame:
    """``delete`` rows for rows with the ``path`` of a file.

    None for documents known by their content: those are never removed.
    """
    if options.id_mode == "content":
        deleted = deleted.limit(0)
    return _deletes(deleted, F.lit(options.index), path_id(F.col("path"), options.id_mode))


def folder_delete_ops(folders: DataFrame, options: CrawlOptions) -> DataFrame:
    return _deletes(folders, F.lit(options.folder_index), F.col("path"))


def requested_deletes(requests: DataFrame, options: CrawlOptions) -> DataFrame:
    """``delete`` rows for rows with ``key`` (a file name or an id) and ``index``."""
    index = F.coalesce(F.nullif(F.col("index"), F.lit("")), F.lit(options.index))
    keys = requests.select(F.col("key").alias("path"), index.alias("index")).distinct()
    return _deletes(keys, F.col("index"), F.col("path"))


def upload_ops(uploads: DataFrame, options: CrawlOptions, unique: bool = False) -> DataFrame:
    """``index`` rows of built uploads, in the order of ``upload_id``; simulated ones stay out.

    Uploads of one number are ordered by their bytes, then by their row, so no two operations
    share a place; their rows must have been written for that. Where numbers are ``unique`` they are all
    it takes, and a count of the operations reads no content.
    """
    written = ~F.coalesce("simulate", F.lit(False)) & F.col("error").isNull()
    # From the lowest number on, so that text sorts like numbers.
    number = F.col("upload_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    place = [F.lpad(number.cast("string"), 20, "0")]
    if not unique:
        row = F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")
        place += [F.coalesce(F.md5("data"), F.lit("")), row]
    return uploads.select(
        "*", F.array(*place).alias("ord")
    ).filter(written).select(
        F.lit(PHASE_FILE).alias("phase"),
        "ord",
        F.lit("index").alias("op"),
        "_index",
        "_id",
        F.col("filename").alias("path"),
        "doc",
    ).to(OPS)


def run_summary(ops: DataFrame) -> DataFrame:
    """Operations per run, index and kind."""
    return ops.groupBy("run_id", "_index", "op").agg(F.count("*").alias("operations"))


def bulk_lines(ops: DataFrame) -> DataFrame:
    """Action and body lines of a bulk request, each with its place within its operation."""
    return ops.filter(F.col("op").isin("index", "delete")).select(
        *[c for c in ("run_id", "phase", "ord") if c in ops.columns],
        F.posexplode(_request_lines()).alias("pos", "line"),
    )


def _request_lines() -> Column:
    body = F.when(F.col("op") == "index", document_json(F.col("doc")))
    return F.array_compact(F.array(action_json(F.col("op"), F.col("_index"), F.col("_id")), body))


def bulk_requests(ops: DataFrame, options: CrawlOptions) -> DataFrame:
    """``batch, operations, bytes, body``: bulk requests of at most ``bulk_size`` operations.

    A request closes once it holds ``bulk_size`` operations or ``byte_size`` bytes of lines, as
    the operations come in their order; so it exceeds the bytes by one document at most.
    """
    keys = [c for c in ("run_id", "phase", "ord") if c in ops.columns]
    # One row per operation: its lines together, each with its end.
    lines = ops.filter(F.col("op").isin("index", "delete")).select(
        *keys, "_index", "_id", F.concat_ws("\n", _request_lines()).alias("lines")
    )
    order = [*keys, "_index", "_id"]
    sizes = lines.select(*order, (F.octet_length("lines") + 1).alias("bytes"))
    batches = bulk_batches(sizes, order, options.bulk_size, options.byte_size)
    named = lines.join(batches.select(*order, "position", "batch", "bytes"), order)
    # Bounded by the size of a request.
    return named.groupBy("batch").agg(
        F.count("*").alias("operations"),
        F.sum("bytes").alias("bytes"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("position", "lines"))), lambda r: r["lines"]), "\n"
        ).alias("body"),
    )


def write_bulk_lines(ops: DataFrame, target: str, options: CrawlOptions) -> None:
    """Text files of bulk requests in their order; no file begins or ends within a request."""
    requests = bulk_requests(ops, options)
    ordered = requests.repartitionByRange("batch").sortWithinPartitions("batch")
    ordered.select("body").write.mode("overwrite").text(target)
