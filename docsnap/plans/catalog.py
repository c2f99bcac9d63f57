"""The registered queries: one per operator, over the derived frames."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsnap.functions import content, hashing, metadata, render, units
from docsnap.functions.names import extension, file_name
from docsnap.functions.paths import virtual_path
from docsnap.operators import diff, extract, filters, ops, state, terms
from docsnap.operators.batches import bulk_batches
from docsnap.operators.digests import DigestSnapshot
from docsnap.operators.documents import with_document
from docsnap.operators.events import accepted_events, latest_events
from docsnap.operators.facets import path_tree_facets
from docsnap.operators.folders import folder_documents, folders_of
from docsnap.operators.position import with_position
from docsnap.operators.uploads import build_uploads
from docsnap.options import CrawlOptions
from docsnap.functions.paths import walk_order
from docsnap.plans import derived, trees
from docsnap.plans.counts import KeptCounts, index_deltas, path_deltas
from docsnap.plans.crawl import crawl, next_snapshot
from docsnap.plans.store import DocumentStore
from docsnap.session import WorkTables, materialised, shared_folder, spread
from docsnap.schema import TEXT_KEY
from docsnap.sources.content import read_and_extract
from docsnap.sources.snapshot import json_snapshot
from docsnap.sources.storage import list_storage, storage_listing
from docsnap.sources.tree import list_names, with_stats
from docsnap.streaming.events import crawl_then_follow, follow_events
from docsnap.streaming.operations import OperationsSource
from docsnap.streaming.recrawl import recrawl

Query = Callable[[SparkSession, str], DataFrame]

OPTIONS = CrawlOptions(root="/data", name="job", excludes=("*.tmp",))
INCLUDES = ("*.txt", "doc_1*", "*[2-4].MD")
EXCLUDES = ("*.tmp", "doc_?5*")
BULK_SIZE, BYTE_SIZE = 10, 20_000


def _indexed_at():
    return F.lit("2024-02-01T00:00:00Z").cast("timestamp")


_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _file_rows(files: DataFrame, metadata: Column | None = None) -> DataFrame:
    """Files as read and extracted: text, bytes, metadata, no error."""
    empty = F.map_from_arrays(F.array(), F.array()).cast("map<string,array<string>>")
    return files.select(
        "doc_id", "path", "length", "mtime",
        (empty if metadata is None else metadata).alias("metadata"),
        F.array("text").alias("text"),
        F.col("text").cast("binary").alias("data"),
        F.lit(None).cast("string").alias("error"),
    )


# -- filters ------------------------------------------------------------------------------


@query
def include_filter(spark, folder):
    options = CrawlOptions(root="/data", includes=INCLUDES)
    return filters.eligible_files(derived.files(spark, folder), options).select("path")


@query
def exclude_filter(spark, folder):
    options = CrawlOptions(root="/data", excludes=EXCLUDES)
    return filters.eligible_files(derived.files(spark, folder), options).select("path")


@query
def size_guard(spark, folder):
    return filters.size_guard(derived.files(spark, folder), 5000).select("path", "length")


@query
def eligible_files(spark, folder):
    options = CrawlOptions(
        root="/data", includes=INCLUDES, excludes=EXCLUDES, ignore_above=20_000
    )
    return filters.eligible_files(derived.files(spark, folder), options).select("path", "length")


@query
def pause_filter(spark, folder):
    kept = filters.outside_pauses(derived.events(spark, folder), derived.pauses(spark, folder))
    return kept.select("event_id", "src_path")


@query
def pauses_of_years(spark, folder):
    """Pauses of up to thirty years and of minutes; a third of all events fall on one day, many at one moment."""
    day = F.expr("timestamp_ntz'2024-01-10 00:00:00' + make_dt_interval(0, 0, 0, if(event_id % 2 = 0, 0, event_id % 86400))")
    rows = derived.events(spark, folder).withColumn("ts", F.when(F.col("event_id") % 3 == 0, day).otherwise(F.col("ts")))
    short = derived.pauses(spark, folder)
    long = short.selectExpr("start_ts - interval 30 years as start_ts", "start_ts - interval 20 days as end_ts")
    kept = filters.outside_pauses(rows, short.unionByName(long))
    return kept.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


# -- comparison with the snapshot ---------------------------------------------------------


@query
def change_feed(spark, folder):
    now = derived.files(spark, folder).select("path", "mtime")
    return diff.change_feed(now, derived.previous(spark, folder))


@query
def change_feed_by_digest(spark, folder):
    """The same from digests of directories and parts; files of unchanged directories are not compared."""
    now = derived.files(spark, folder).select("path", F.col("mtime").cast("double"))
    snapshot = DigestSnapshot(spark, f"{shared_folder(spark)}/digests-{uuid.uuid4().hex}")
    snapshot.write(derived.previous(spark, folder))
    return snapshot.change_feed(now, WorkTables(spark))


@query
def new_or_modified(spark, folder):
    now = derived.files(spark, folder).select("path", "mtime")
    return diff.new_or_modified(now, derived.previous(spark, folder)).select("path", "mtime")


@query
def deleted_files(spark, folder):
    """Deletions after a pattern was added: files that are excluded now count as well."""
    now = filters.eligible_files(derived.files(spark, folder), OPTIONS)
    return diff.deleted(now, derived.previous(spark, folder))


@query
def next_snapshot_rows(spark, folder):
    """The snapshot after a run in which every eleventh file failed."""
    now = derived.files(spark, folder).select("path", "mtime", "doc_id")
    feed = diff.change_feed(now, derived.previous(spark, folder))
    failed = feed.filter("status in ('new', 'modified') and doc_id % 11 = 0")
    return next_snapshot(feed, failed)


# -- document fields ----------------------------------------------------------------------


@query
def file_info(spark, folder):
    name = file_name(F.col("path"))
    return derived.files(spark, folder).select(
        "doc_id",
        name.alias("filename"),
        extension(name).alias("extension"),
        F.col("length").alias("filesize"),
        content.indexed_chars_of(F.col("text")).alias("indexed_chars"),
        render.iso_utc(F.timestamp_seconds("mtime")).alias("last_modified"),
        F.col("path").alias("url"),
    )


@query
def path_info(spark, folder):
    """Virtual paths below the root, and below a root that holds only a part of the files."""
    return derived.files(spark, folder).select(
        "doc_id",
        F.col("path").alias("real"),
        virtual_path(F.col("path"), "/data/").alias("virtual"),
        virtual_path(F.col("path"), "/data/src1").alias("virtual_in_part"),
    )


@query
def folder_docs(spark, folder):
    folders = folders_of(derived.files(spark, folder), "/data")
    return folder_documents(folders, "/data").select(
        "_id", "path_info.real", "path_info.root", "path_info.virtual"
    )


@query
def content_type(spark, folder):
    return derived.raw_metadata(spark, folder).select(
        "doc_id", content.content_type(F.col("metadata")).alias("content_type")
    )


@query
def content_truncate(spark, folder):
    """Text in two parts with white space of several kinds around it, cut to 200 characters."""
    parts = F.array(F.concat(F.lit(" \n \t"), F.col("text")), F.lit("tail  \n"))
    short = content.content_text(parts, 200)
    whole = content.content_text(parts, -1)
    return derived.files(spark, folder).select(
        "doc_id",
        short.alias("content"),
        content.indexed_chars_of(short).alias("indexed_chars"),
        F.md5(whole).alias("whole_md5"),
    )


@query
def checksum(spark, folder):
    data = F.col("text").cast("binary")
    return derived.files(spark, folder).select(
        "doc_id",
        hashing.checksum(data, "MD5").alias("md5"),
        hashing.checksum(data, "SHA-1").alias("sha1"),
        hashing.checksum(data, "sha-256").alias("sha256"),
        hashing.checksum(data, "crc-99").alias("unknown"),
    )


@query
def doc_id_path(spark, folder):
    return derived.files(spark, folder).select(
        "doc_id", hashing.path_id(F.col("path"), "path").alias("_id")
    )


@query
def doc_id_path_hash(spark, folder):
    return derived.files(spark, folder).select(
        "doc_id", hashing.path_id(F.col("path"), "path_hash").alias("_id")
    )


@query
def doc_id_content_hash(spark, folder):
    """Ids by content; of equal contents the last path of the walk stays."""
    options = CrawlOptions(root="/data", id_mode="content")
    rows = _file_rows(derived.files(spark, folder))
    log = ops.file_ops(with_document(rows, options, _indexed_at()), options)
    return state.current_state(log.withColumn("run_id", F.lit(1))).select(
        "_id", "path", F.md5(F.col("doc.content")).alias("content_md5")
    )


@query
def metadata_map(spark, folder):
    meta = derived.raw_metadata(spark, folder).select(
        "doc_id", metadata.meta_struct("metadata").alias("meta")
    )
    return meta.select("doc_id", "meta.*")


@query
def typed_meta(spark, folder):
    meta = derived.raw_metadata(spark, folder).select(
        "doc_id", metadata.meta_struct("metadata").alias("meta")
    )
    typed = meta.select(
        "doc_id",
        metadata.typed_meta("meta").alias("typed"),
        F.array_join(metadata.rejected_fields("meta"), ",").alias("rejected"),
    )
    return typed.selectExpr(
        "doc_id", "unix_micros(typed.date) as date_us", "cast(typed.rating as bigint) as rating",
        "rejected",
    )


@query
def attachment_b64(spark, folder):
    return derived.files(spark, folder).select(
        "doc_id", render.base64_text(F.col("text").cast("binary")).alias("attachment")
    )


def _documents(spark, folder, options: CrawlOptions) -> DataFrame:
    """Built documents of all files, with their metadata."""
    rows = _file_rows(derived.files_with_metadata(spark, folder), F.col("metadata"))
    return with_document(rows, options, _indexed_at())


@query
def doc_json(spark, folder):
    options = CrawlOptions(root="/data", checksum="SHA-1", store_source=True)
    return _documents(spark, folder, options).select(
        "doc_id", render.document_json(F.col("doc")).alias("json")
    )


@query
def parse_duration(spark, folder):
    text = F.expr(
        """concat(' ', cast(n_chars % 90 as string), case when n_chars % 3 = 0 then '.5' else '' end,
             case n_chars % 7 when 0 then 'ms' when 1 then ' s' when 2 then 'M' when 3 then 'h'
                             when 4 then 'd' when 5 then '' else 'weeks' end)"""
    )
    return derived.table(spark, folder, "documents").select(
        "doc_id", units.parse_duration(text, on_invalid="null").alias("seconds")
    )


@query
def parse_byte_size(spark, folder):
    text = F.expr(
        """concat(cast(n_chars % 90 as string), case when n_chars % 3 = 0 then '.7' else '' end,
             case n_chars % 7 when 0 then 'b' when 1 then ' kb' when 2 then 'MB' when 3 then 'gb'
                             when 4 then 'tb ' when 5 then '' else 'pb' end)"""
    )
    return derived.table(spark, folder, "documents").select(
        "doc_id", units.parse_byte_size(text, on_invalid="null").alias("bytes")
    )


@query
def parse_indexed_chars(spark, folder):
    text = F.expr(
        """concat(case when n_chars % 4 = 0 then '-' else '' end, cast(n_chars as string),
             case n_chars % 3 when 0 then '.9' when 1 then '' else 'x' end)"""
    )
    return derived.table(spark, folder, "documents").select(
        "doc_id", units.parse_indexed_chars(text, on_invalid="null").alias("chars")
    )


@query
def html_title_lang(spark, folder):
    return derived.table(spark, folder, "pages").select(
        "page_id",
        extract.html_title(F.col("html")).alias("title"),
        extract.html_language(F.col("html")).alias("lang"),
    )


@query
def html_text(spark, folder):
    return spread(derived.table(spark, folder, "pages")).select(
        "page_id", extract.html_text(F.col("html")).alias("text")
    )


#: Letters that stand for those of the texts, and the encodings the texts are written in.
ALPHABETS = {
    "cp932": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひ",
    "euc_jp": "アイウエオカキクケコサシスセソタチツテト日本語文字東京",
    "gb18030": "的一是在不了有和人这中大为上个国我以要他时来用们生到",
    "big5hkscs": "的一是在不了有和人這中大為上個國我以要他時來用們生到",
    "cp949": "가나다라마바사아자차하고노도로모보소오조호구누두무부",
    "cp1251": "абвгдежзийклмнопрстуфхцчшщ",
    "koi8_r": "абвгдежзийклмнопрстуфхцчшщ",
    "utf-16": "αβγδεζηθικλμνξοπρστυφχψωάέ",
}


@query
def found_encodings(spark, folder):
    """Texts in eight alphabets, written in the encodings these are used with and read without a hint."""

    @F.pandas_udf("binary")
    def written(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        names = list(ALPHABETS)
        return pd.Series([text.encode(names[n % len(names)], "replace") for text, n in zip(texts, numbers)])

    turned = F.lower("text")
    names = list(ALPHABETS)
    small = "abcdefghijklmnopqrstuvwxyz"
    for n, name in enumerate(names):
        turned = F.when(F.col("doc_id") % len(names) == n, F.translate(F.lower("text"), small, ALPHABETS[name])).otherwise(turned)
    # What an alphabet cannot write stays out.
    kept = F.regexp_replace(turned, r"[\x7f-\u02ff\u2000-\u2fff]", "")
    rows = derived.table(spark, folder, "documents").select("doc_id", kept.alias("text")).filter("length(text) >= 40")
    read = rows.select("doc_id", extract.decoded(written("text", "doc_id")).alias("text"))
    return read.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


# -- uploads and requests -----------------------------------------------------------------


def _uploads(spark, folder) -> DataFrame:
    return build_uploads(
        derived.uploads(spark, folder), extract.text_extractor, OPTIONS, _indexed_at()
    )


@query
def upload_docs(spark, folder):
    shown = F.when(F.col("debug"), render.document_json(F.col("doc")))
    return _uploads(spark, folder).select(
        "upload_id", "_index", "_id", "url",
        "doc.file.content_type", "doc.file.extension", "doc.file.filesize",
        "doc.path.virtual",
        F.md5(F.col("doc.content")).alias("content_md5"),
        F.md5(shown).alias("shown_md5"),
        (~F.col("simulate")).alias("written"),
    )


@query
def upload_state(spark, folder):
    """What the uploads leave behind: the last one per index and id."""
    log = ops.upload_ops(_uploads(spark, folder), OPTIONS, unique=True).withColumn("run_id", F.lit(1))
    return state.current_state(log).select(
        "_index", "_id", F.md5(F.col("doc.content")).alias("content_md5")
    )


@query
def delete_requests(spark, folder):
    return ops.requested_deletes(derived.delete_requests(spark, folder), OPTIONS).select(
        "op", "_index", "_id"
    )


@query
def delete_ops(spark, folder):
    """Deletions known by the hash of their path; none at all for ids by content."""
    now = filters.eligible_files(derived.files(spark, folder), OPTIONS)
    gone = diff.deleted(now, derived.previous(spark, folder))
    hashed = CrawlOptions(root="/data", name="job", id_mode="path_hash")
    by_content = CrawlOptions(root="/data", name="immutable", id_mode="content")
    return (
        ops.delete_ops(gone, hashed)
        .unionByName(ops.delete_ops(gone, by_content))
        .select("op", "_index", "_id", "path")
    )


# -- the log of operations ----------------------------------------------------------------


def _log(spark, folder) -> DataFrame:
    """Two runs over the files, then the uploads.

    Run 1 indexes what the previous snapshot knows; run 2 writes folders, new and modified
    files and deletions.
    """
    first = derived.previous(spark, folder).select(
        "path", "mtime",
        F.octet_length("path").alias("length"),
        F.map_from_arrays(F.array(), F.array()).cast("map<string,array<string>>").alias("metadata"),
        F.array(F.concat(F.lit("v1 "), "path")).alias("text"),
        F.lit(None).cast("string").alias("error"),
    )
    now = derived.files(spark, folder)
    feed = diff.change_feed(now.select("path", "mtime"), derived.previous(spark, folder))
    changed = feed.filter("status in ('new', 'modified')").select("path")
    second = now.join(changed, "path", "left_semi").select(
        "path", "mtime", "length",
        F.map_from_arrays(F.array(), F.array()).cast("map<string,array<string>>").alias("metadata"),
        F.array("text").alias("text"),
        F.when(F.col("doc_id") % 13 == 0, "unreadable").alias("error"),
    )

    def run(run_id: int, rows: DataFrame) -> DataFrame:
        return rows.withColumn("run_id", F.lit(run_id).cast("bigint"))

    gone = diff.deleted(now, derived.previous(spark, folder))
    return (
        run(1, ops.file_ops(with_document(first, OPTIONS, _indexed_at()), OPTIONS))
        .unionByName(run(2, ops.folder_ops(folders_of(now, "/data"), OPTIONS)))
        .unionByName(run(2, ops.file_ops(with_document(second, OPTIONS, _indexed_at()), OPTIONS)))
        .unionByName(run(2, ops.delete_ops(gone, OPTIONS)))
        .unionByName(run(3, ops.upload_ops(_uploads(spark, folder), OPTIONS, unique=True)))
    )


@query
def current_state(spark, folder):
    return state.current_state(materialised(_log(spark, folder))).select(
        "_index", "_id", "run_id", F.md5(F.col("doc.content")).alias("content_md5")
    )


@query
def index_counts(spark, folder):
    return state.documents_per_index(_log(spark, folder))


@query
def run_summary(spark, folder):
    return ops.run_summary(_log(spark, folder))


@query
def alias_union(spark, folder):
    return state.alias_view(state.current_state(materialised(_log(spark, folder)))).select(
        "_index", "_id", "path.virtual", "file.filesize"
    )


@query
def scan_order(spark, folder):
    keyed = derived.files(spark, folder).select("path", walk_order(F.col("path")).alias("ord"))
    return with_position(keyed, ["ord"]).select("path", "position")


@query
def bulk_batches_by_size(spark, folder):
    rows = derived.files(spark, folder).select(
        walk_order(F.col("path")).alias("ord"), "path", F.col("length").alias("bytes")
    )
    return bulk_batches(rows, ["ord"], BULK_SIZE, BYTE_SIZE).select("path", "batch")


@query
def bulk_lines(spark, folder):
    """Request lines of the file pass of run 2: an action, and a body where one belongs."""
    log = _log(spark, folder).filter("run_id = 2 and phase <> 0")
    return ops.bulk_lines(log).select(
        F.array_join("ord", "/").alias("path"), "phase", "pos",
        "line",
    )


# -- tables over the documents ------------------------------------------------------------


@query
def path_tree_counts(spark, folder):
    return path_tree_facets(derived.files(spark, folder), "path")


@query
def kept_path_counts(spark, folder):
    """Counts after three runs, kept up by what came and went in each."""
    counts = KeptCounts(spark, f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}")
    listings = [derived.previous(spark, folder), derived.files(spark, folder), derived.files(spark, folder).filter("doc_id % 4 <> 1")]
    listings = [rows.select("path", "mtime") for rows in listings]
    for run_id, (before, now) in enumerate(zip([listings[0].limit(0), *listings], listings, strict=False), 1):
        feed = diff.change_feed(now, before)
        counts.add(run_id, path_deltas(feed).unionByName(index_deltas(feed, OPTIONS.index)))
        if run_id == 2:
            counts.fold()
    return counts.counts()


@query
def term_postings(spark, folder):
    return terms.term_postings(derived.texts(spark, folder), "doc_id", "text")


@query
def term_document_frequency(spark, folder):
    return terms.document_frequency(derived.texts(spark, folder), "text")


# -- events -------------------------------------------------------------------------------


@query
def event_ops(spark, folder):
    return accepted_events(derived.events(spark, folder), OPTIONS).select(
        "event_id", "op", F.col("src_path").alias("_id")
    )


@query
def event_latest(spark, folder):
    accepted = accepted_events(
        derived.events(spark, folder), OPTIONS, derived.pauses(spark, folder)
    )
    return latest_events(accepted).select("path", "event_id", "op")


# -- whole passes over the tables, in a store --------------------------------------------------


PASS = CrawlOptions(root="/data", name="job", excludes=("*.tmp",), continue_on_error=True)


def _load(spark, folder, fails: str):
    """A loader that takes texts from the table; some files cannot be read."""
    texts = derived.files(spark, folder).select("path", "doc_id", F.col("text").alias("whole"))

    def load(changed: DataFrame) -> DataFrame:
        rows = changed.join(texts, "path", "left")
        return rows.select(
            "path", "length", "mtime",
            F.map_from_arrays(F.array(), F.array()).cast("map<string,array<string>>").alias("metadata"),
            F.array(F.coalesce("whole", F.lit("gone"))).alias("text"),
            F.expr(f"if({fails}, 'unreadable', null)").alias("error"),
        )

    return load


def _passes(spark, folder, second: CrawlOptions = PASS, runs: int = 3, compact: bool = False) -> DocumentStore:
    """The previous files, then the files of now with some failures, then the same without."""
    store = DocumentStore(spark, f"{shared_folder(spark)}/passes-{uuid.uuid4().hex}")

    def before(spark, _):
        return derived.previous(spark, folder).withColumn("length", F.octet_length("path").cast("bigint"))

    def now(spark, _):
        return derived.files(spark, folder).select("path", "length", "mtime")

    steps = ((before, PASS, "false"), (now, second, "doc_id % 13 = 0"), (now, second, "false"))
    for listing, options, fails in steps[:runs]:
        crawl(spark, options, store, listing=listing, load=_load(spark, folder, fails))
        if compact:
            store.compact()
    return store


def _contents(store: DocumentStore) -> DataFrame:
    return store.documents().select("_index", "_id", F.md5("content").alias("content_md5"))


@query
def crawl_two_runs(spark, folder):
    """New, modified, deleted, failed and retried files, as documents after three passes."""
    return _contents(_passes(spark, folder))


@query
def crawl_keeps_deleted(spark, folder):
    """The same where deleted files keep their documents, and every pass is compacted."""
    options = CrawlOptions(root="/data", name="job", excludes=("*.tmp",), continue_on_error=True, remove_deleted=False)
    return _contents(_passes(spark, folder, options, compact=True))


@query
def crawl_snapshot(spark, folder):
    """The snapshot after the pass with failures: those are tried again, so their old time stays."""
    return _passes(spark, folder, runs=2).snapshot(PASS.job)


@query
def crawl_errors(spark, folder):
    return _passes(spark, folder).errors()


@query
def crawl_folders(spark, folder):
    return _passes(spark, folder, runs=1).folders().select("_index", "_id", "path.virtual")


@query
def crawl_then_events(spark, folder):
    """A pass, then the event table as a stream into the same store."""
    store = _passes(spark, folder, runs=1)
    _follow(spark, folder, store)
    return store.documents().select("_index", "_id", F.md5("content").alias("content_md5"))


@query
def event_stream_state(spark, folder):
    """The event table as a stream into a store; the documents it leaves behind."""
    store = DocumentStore(spark, f"{shared_folder(spark)}/events-{uuid.uuid4().hex}")
    _follow(spark, folder, store)
    return store.documents().select("_index", "_id", "content")


def _event_load(fails: str):
    def load(paths: DataFrame) -> DataFrame:
        return paths.withColumn("user_id", F.regexp_extract("path", "u([0-9]+)", 1).cast("long")).select(
            "path",
            F.lit(0).alias("length"),
            F.lit(None).cast("double").alias("mtime"),
            F.map_from_arrays(F.array(), F.array()).cast("map<string,array<string>>").alias("metadata"),
            F.array(F.concat(F.lit(" content of "), "path")).alias("text"),
            F.expr(f"if({fails}, 'unreadable', null)").alias("error"),
        )

    return load


def _follow(spark, folder, store: DocumentStore, fails: str = "false") -> None:
    schema = derived.table(spark, folder, "events").schema
    # As a pattern the path may name a single file as well as a folder of files.
    rows = spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")

    follow_events(
        derived.events_from(rows), store, OPTIONS, f"{store.location}/checkpoint",
        load=_event_load(fails), pauses=derived.pauses(spark, folder), trigger={"availableNow": True},
    ).awaitTermination()


# -- trees of files ------------------------------------------------------------------------------


def _below(root: str, path: str = "path") -> Column:
    return F.substring(F.col(path), len(root) + 2, 1 << 20).alias("path")


@query
def tree_listing(spark, folder):
    """Files and directories of a tree, by the data source; few directories a task, so in rounds."""
    root = trees.written_tree(spark, folder)
    return list_storage(spark, root, most=3).select(_below(root), "is_dir", "length")


@query
def tree_names(spark, folder):
    """The same by level, with sizes looked up after a name pattern."""
    root = trees.written_tree(spark, folder)
    options = CrawlOptions(root=root, excludes=EXCLUDES)
    names = list_names(spark, root).filter("not is_dir")
    return filters.eligible_files(with_stats(names.select("path")), options).select(_below(root), "length")


@query
def tree_links(spark, folder):
    """Links are followed, but not back up; what they name is listed under their names."""
    root = trees.written_tree(spark, folder, links=True)
    listed = list_storage(spark, root, follow_symlinks=True).filter("not is_dir")
    return listed.select(_below(root)).groupBy(F.col("path").endswith("a_link.txt").alias("link")).agg(
        F.count("*").alias("files")
    )


@query
def tree_without_links(spark, folder):
    root = trees.written_tree(spark, folder, links=True)
    return list_names(spark, root).select(_below(root), "is_dir", "is_symlink")


@query
def vanished_files(spark, folder):
    """Files that go between the listing and the look at their sizes drop out without an error."""
    root = trees.written_tree(spark, folder)
    names = list_names(spark, root).filter("not is_dir").select("path")
    trees.removed(spark, names.filter("path like '%.tmp'"))
    return with_stats(names).select(_below(root), "length")


@query
def read_files(spark, folder):
    """Contents as read from files; one that has gone meanwhile has an error instead."""
    root = trees.written_tree(spark, folder)
    files = list_storage(spark, root).filter("not is_dir").select("path", "length", "mtime")
    trees.removed(spark, files.filter("path like '%.tmp'"))
    read = read_and_extract(files, extract.text_extractor, keep_data=True)
    return read.select(
        _below(root), F.md5("data").alias("md5"), F.substring_index("error", ":", 1).alias("error")
    )


@query
def python_extractor(spark, folder):
    """Documents by a Python function, which fails for some; the others go on."""

    def parse(data: bytes) -> dict:
        text = data.decode()
        if len(text) % 7 == 0:
            raise ValueError(len(text))
        return {"dc:title": text[:20], "Keywords": [text[20:25], "more"], TEXT_KEY: [text[:50], text[50:80]]}

    rows = _file_rows(derived.files(spark, folder)).select("doc_id", "path", "length", "mtime", "data")
    built = with_document(extract.PythonExtractor(parse)(rows), OPTIONS, _indexed_at())
    good = built.withColumn("doc", F.when(F.col("error").isNull(), F.col("doc")))
    return good.select(
        "doc_id", "error", "doc.meta.title", "doc.meta.keywords", F.md5("doc.content").alias("content_md5")
    )


@query
def snapshot_import(spark, folder):
    """The previous snapshot from a JSON object on one line, read in ranges of 16 kB."""
    place = trees.written_json(spark, derived.previous(spark, folder).select("path", F.col("mtime").cast("double")))
    return json_snapshot(spark, place, 1 << 14)


@query
def crawl_tree(spark, folder):
    """A pass over files: listed by the data source, read, extracted and stored."""
    root = trees.written_tree(spark, folder)
    options = CrawlOptions(root=root, name="job", excludes=("*.tmp", "*.html"))
    store = DocumentStore(spark, f"{shared_folder(spark)}/passes-{uuid.uuid4().hex}")
    crawl(spark, options, store, extract.text_extractor, listing=storage_listing)
    return store.alias().select(
        "_index", F.col("path.virtual").alias("virtual"), "file.filesize", F.md5("content").alias("content_md5")
    )


# -- passes and streams together --------------------------------------------------------------


@query
def bootstrap_then_stream(spark, folder):
    """A pass, then the events from its beginning on; those of before are left out."""
    store = DocumentStore(spark, f"{shared_folder(spark)}/passes-{uuid.uuid4().hex}")
    rows = derived.events_from(spark.readStream.schema(derived.table(spark, folder, "events").schema).parquet(f"{folder}/event[s].parquet"))
    late = rows.withColumn("ts", F.expr("if(event_id % 2 = 0, ts + interval 900 years, ts)"))

    def now(spark, _):
        return derived.files(spark, folder).select("path", "length", "mtime")

    crawl_then_follow(
        spark, late, store, PASS, f"{store.location}/checkpoint", listing=now, load_files=_load(spark, folder, "false"),
        load=_event_load("user_id % 5 = 0"), trigger={"availableNow": True},
    ).awaitTermination()
    return _contents(store)


@query
def periodic_passes(spark, folder):
    """One pass for each tick of a stream, over the files of now."""
    store = DocumentStore(spark, f"{shared_folder(spark)}/passes-{uuid.uuid4().hex}")
    schema = derived.table(spark, folder, "region").schema
    ticks = spark.readStream.schema(schema).parquet(f"{folder}/regio[n].parquet")

    def now(spark, _):
        return derived.files(spark, folder).select("path", "length", "mtime")

    recrawl(
        spark, PASS, store, f"{store.location}/checkpoint", listing=now, load=_load(spark, folder, "doc_id % 13 = 0"),
        ticks=ticks, trigger={"availableNow": True},
    ).awaitTermination()
    return _contents(store)


@query
def stream_errors(spark, folder):
    """Files of events that cannot be processed become error rows; the others go on."""
    store = DocumentStore(spark, f"{shared_folder(spark)}/events-{uuid.uuid4().hex}")
    _follow(spark, folder, store, "user_id % 5 = 0")
    return store.errors().select("path", "error").unionByName(store.documents().select(F.col("_id").alias("path"), F.lit("").alias("error")))


@query
def operations_stream(spark, folder):
    """The operations of three passes as a stream that is read in two goes, with a compaction between."""
    spark.dataSource.register(OperationsSource)
    place = f"{shared_folder(spark)}/copy-{uuid.uuid4().hex}"
    store = _passes(spark, folder, runs=2)

    def follow() -> None:
        operations = spark.readStream.format("operations").option("location", store.location).load()
        operations.select("run_id", "op", "path", F.md5("doc.content").alias("content_md5")).writeStream.option(
            "checkpointLocation", f"{place}/checkpoint"
        ).trigger(availableNow=True).start(f"{place}/rows", format="parquet").awaitTermination()

    follow()
    store.compact()
    crawl(
        spark, PASS, store, listing=lambda spark, _: derived.files(spark, folder).select("path", "length", "mtime"),
        load=_load(spark, folder, "false"),
    )
    follow()
    rows = spark.read.schema("run_id long, op string, path string, content_md5 string").parquet(f"{place}/rows")
    return rows.filter("path like '/data/%/%/%'")
