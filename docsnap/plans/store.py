"""The store: an append-only log of operations, snapshots, and what was committed.

    ops/run_id=N        operations of run N
    snapshot/run_id=N   the snapshot run N ended with
    state/run_id=N      documents that compaction N wrote, a piece of the state
    dead/run_id=N       keys of documents in older pieces that it replaced or deleted
    tombs/run_id=N      deletions that a run which was still open might precede
    responses/run_id=N  what became of the uploads of run N
    claims/run_id=N     a file of each writer that wanted the id
    commits/run_id=N    one row, written last

A run counts once its commit is there. A writer puts a file of its own name among the claims of an
id and takes the id only if it then finds no other there; of two that meet, the later to look
always sees both, so they never share an id, and storage need only list what was written. Of two operations
on a document that of the higher id counts. What a failed run left is never read, and ``prune``
deletes it. A crawl is compared with the newest committed crawl of the same job, which is a name and
a root; a compaction lists the runs it covers, so that one which was committed later is still read.

The state is kept in pieces, each in the same buckets by document (see ``Layout``).
"""

from __future__ import annotations

import hashlib
import random
import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsnap.functions.metadata import rejected_fields, typed_meta
from docsnap.operators.state import (
    KEY, ORDER, alias_view, current_state, last_operations, newer_operations, settled_rows, untouched,
)
from docsnap.plans.layout import Layout, bucket_of
from docsnap.schema import COMMITS, DEAD, OPS, RESPONSES, SNAPSHOT, STATE, TOMBS
from docsnap.session import WorkTables, filesystem, shuffle_width

TABLES = {
    "ops": OPS, "snapshot": SNAPSHOT, "state": STATE, "dead": DEAD, "tombs": TOMBS, "responses": RESPONSES,
    "commits": COMMITS,
}


#: Share of dead documents above which a bucket is written anew, and pieces a state may have.
DEAD_SHARE, MOST_PIECES = 0.25, 6


class DocumentStore:
    def __init__(self, spark: SparkSession, location: str) -> None:
        self.spark = spark
        self.location = location.rstrip("/")
        self._ensure()

    # -- tables ---------------------------------------------------------------------------

    def _path(self, table: str, run_id: int | None = None) -> str:
        part = "" if run_id is None else f"/run_id={run_id}"
        return f"{self.location}/{table}{part}"

    def _ensure(self) -> None:
        """Create what is missing: each table starts with an empty run 0."""
        for table, schema in TABLES.items():
            files, target = filesystem(self.spark, self._path(table))
            if not files.exists(target):
                empty = self.spark.createDataFrame([], schema)
                empty.coalesce(1).write.mode("overwrite").parquet(self._path(table, 0))

    def _read(self, table: str) -> DataFrame:
        schema = T.StructType(TABLES[table].fields + [T.StructField("run_id", T.LongType())])
        return self.spark.read.schema(schema).parquet(self._path(table))

    def _ids(self, table: str) -> list[int]:
        """Run ids by the names of folders and files; no file is opened."""
        files, target = filesystem(self.spark, self._path(table))
        if not files.exists(target):
            return []
        names = (entry.getPath().getName() for entry in files.listStatus(target))
        return sorted(int(name.split("=")[1]) for name in names if name.startswith("run_id="))

    def _newest(self, kind: str, job: str | None = None):
        """The newest commit of that kind, or nothing."""
        commits = self._read("commits").filter(F.col("kind") == kind)
        if job is not None:
            commits = commits.filter(F.col("job") == job)
        return commits.orderBy(F.desc("run_id")).first()

    # -- writing --------------------------------------------------------------------------

    def begin(self, source: str, batch_id: int | None = None) -> tuple[int, bool]:
        """The id of the run to write, and whether that batch was committed before."""
        if batch_id is not None:
            same = (F.col("source") == source) & (F.col("batch_id") == batch_id)
            before = self._read("commits").filter(same).agg(F.max("run_id")).first()[0]
            if before is not None:
                return before, True
        run_id = max([0, *self._ids("commits"), *self._ids("claims")]) + 1
        while not self._claim(run_id):
            run_id += random.randint(1, 4)  # those that met part again
        return run_id, False

    def _claim(self, run_id: int) -> bool:
        """Whether this writer alone wants the id; if not, none of those that met gets it."""
        own = f"writer-{uuid.uuid4().hex}"
        files, target = filesystem(self.spark, f"{self._path('claims', run_id)}/{own}")
        files.create(target, True).close()
        return self._writers(run_id) == [own]

    def _writers(self, run_id: int) -> list[str]:
        files, target = filesystem(self.spark, self._path("claims", run_id))
        return sorted(entry.getPath().getName() for entry in files.listStatus(target))

    def write_ops(self, run_id: int, ops: DataFrame) -> None:
        ops.select(*OPS.fieldNames()).write.mode("overwrite").parquet(self._path("ops", run_id))

    def write_snapshot(self, run_id: int, snapshot: DataFrame) -> None:
        snapshot.select(*SNAPSHOT.fieldNames()).write.mode("overwrite").parquet(
            self._path("snapshot", run_id)
        )

    def write_responses(self, run_id: int, responses: DataFrame) -> None:
        responses.select(*RESPONSES.fieldNames()).write.mode("overwrite").parquet(
            self._path("responses", run_id)
        )

    def commit(
        self,
        run_id: int,
        source: str,
        kind: str,
        batch_id: int | None = None,
        job: str | None = None,
        started: datetime | None = None,
        covers: list[int] | None = None,
        layout: Layout | None = None,
    ) -> None:
        made = layout.fields() if layout else (None,) * 5
        row = self.spark.createDataFrame([(source, batch_id, kind, job, started, covers, *made)], COMMITS)
        row.coalesce(1).write.mode("overwrite").parquet(self._path("commits", run_id))

    # -- reading --------------------------------------------------------------------------

    def written_ops(self, run_id: int) -> DataFrame:
        """Operations of a run whether or not it is committed."""
        return self.spark.read.schema(OPS).parquet(self._path("ops", run_id)).withColumn(
            "run_id", F.lit(run_id).cast("bigint")
        )

    def ops(self, but: list[int] | None = None) -> DataFrame:
        """Operations of committed runs, without those of some."""
        # The commits are few and narrow; joined, they also choose which folders are read.
        commits = self._read("commits").select("run_id")
        if but:
            commits = commits.join(self.spark.createDataFrame([(n,) for n in but], "run_id long"), "run_id", "left_anti")
        return self._read("ops").join(commits, "run_id", "left_semi")

    def errors(self) -> DataFrame:
        return self.ops().filter(F.col("op") == "error").select("run_id", "path", "error")

    def responses(self, run_id: int) -> DataFrame:
        return self._read("responses").filter(F.col("run_id") == run_id).drop("run_id")

    def snapshot(self, job: str | None = None) -> DataFrame:
        """The snapshot of the newest committed crawl of the job; empty before the first."""
        newest = self._newest("crawl", job)
        run_id = newest["run_id"] if newest else 0
        return self._read("snapshot").filter(F.col("run_id") == run_id).drop("run_id")

    def import_snapshot(self, job: str, snapshot: DataFrame) -> int:
        """Take over a snapshot kept elsewhere as that of a job; returns the run id."""
        run_id, _ = self.begin("import")
        self.write_ops(run_id, self.spark.createDataFrame([], OPS))
        self.write_snapshot(run_id, snapshot)
        self.commit(run_id, "import", "crawl", job=job)
        return run_id

    def last_start(self, job: str) -> datetime | None:
        """When the newest committed crawl of the job began, in UTC."""
        newest = self._newest("crawl", job)
        return newest["started"] if newest else None

    def _since_compaction(self) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """Operations that no compaction covers, the compacted state, and where a run older than the
        compaction was committed after it, the order of what the state knows of each document."""
        compacted = self._newest("compact")
        if compacted is None:
            return self.ops(), None, None
        layout = Layout.of(compacted)
        covered = [*compacted["covers"], compacted["run_id"]]
        ops, base = self.ops(but=covered), self._base(layout)
        late = [n for n in self._ids("commits") if 0 < n < compacted["run_id"] and n not in set(covered)]
        if not late:
            return ops, base, None
        tombs = self._tombs(layout.run_id).withColumnRenamed("of_run", "run_id")
        return ops, base, base.select(*KEY, *ORDER).unionByName(tombs.select(*KEY, *ORDER))

    def _base(self, layout: Layout, pieces: tuple[int, ...] | None = None) -> DataFrame:
        """The documents of the state, or of some of its pieces, each piece where it lies."""
        frames = []
        for piece in layout.pieces if pieces is None else pieces:
            rows = layout.counted(self._state_table(piece, layout.buckets), piece)
            frames.append(self._alive(rows, layout, piece))
        return reduce(DataFrame.unionByName, frames).withColumnRenamed("of_run", "run_id")

    def _alive(self, rows: DataFrame, layout: Layout, piece: int) -> DataFrame:
        later = [n for n in layout.pieces if n > piece]
        if not later:
            return rows
        return rows.join(self._dead(later), KEY, "left_anti")

    def _dead(self, pieces: list[int]) -> DataFrame:
        return self._read("dead").filter(F.col("run_id").isin(pieces)).drop("run_id")

    def _tombs(self, run_id: int) -> DataFrame:
        return self._read("tombs").filter(F.col("run_id") == run_id).drop("run_id")

    def _state_table(self, run_id: int, buckets: int) -> DataFrame:
        """A piece of the state as a table in buckets by document, so that joins on the document leave
        it where it is. Each session names it anew."""
        name = self._state_name(run_id)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in STATE.fields)
        self.spark.sql(
            f"create table if not exists {name} ({columns}) using parquet clustered by (`_index`, `_id`) "
            f"into {buckets} buckets location '{self._path('state', run_id)}'"
        )
        return self.spark.table(name)

    def _state_name(self, run_id: int) -> str:
        return f"docsnap_state_{hashlib.md5(self.location.encode()).hexdigest()}_{run_id}"

    def state(self) -> DataFrame:
        """Index operations that make up the current documents and folders."""
        return current_state(*self._since_compaction())

    def counts(self) -> DataFrame:
        """Documents per index."""
        return self.state().groupBy("_index").agg(F.count("*").alias("documents"))

    def alias(self) -> DataFrame:
        """Documents and folders with ``_index``, ``_id`` and their metadata typed."""
        return alias_view(self.state()).withColumn("meta", typed_meta("meta"))

    def documents(self) -> DataFrame:
        return self.alias().filter(F.col("file").isNotNull())

    def folders(self) -> DataFrame:
        return self.alias().filter(F.col("file").isNull()).select("_index", "_id", "path")

    def rejected_metadata(self) -> DataFrame:
        """Metadata fields of current documents whose text does not fit the declared type."""
        return self.state().filter("doc.meta is not null").select(
            "_index", "_id", F.explode(rejected_fields("doc.meta")).alias("field")
        )

    # -- upkeep ---------------------------------------------------------------------------

    def compact(self, dead_share: float = DEAD_SHARE, most_pieces: int = MOST_PIECES) -> int:
        """Write what changed since the last compaction as a new piece of the state.

        A bucket is written anew as a whole once more than ``dead_share`` of its stored documents are
        dead; once there are ``most_pieces`` pieces, all but the oldest become one. Without an earlier
        state, or with another number of buckets, the whole state is written.
        """
        run_id, _ = self.begin("compact")
        self.write_ops(run_id, self.spark.createDataFrame([], OPS))
        committed = self._ids("commits")
        covers = [n for n in committed if 0 < n < run_id]
        still_open = [n for n in self._ids("claims") if n < run_id and n not in set(committed)]
        newest = self._newest("compact")
        before = Layout.of(newest) if newest else None
        buckets = shuffle_width(self.spark)
        ops, base, known = self._since_compaction()
        with WorkTables(self.spark) as work:
            last = work.keep(newer_operations(last_operations(ops), known))
            rows = settled_rows(ops, last, work.keep)
            if before is None or before.buckets != buckets or before.rows is None:
                if base is not None:
                    rows = untouched(base, last).unionByName(rows, allowMissingColumns=True)
                self._write_state(run_id, rows, buckets)
                self._write("dead", run_id, self.spark.createDataFrame([], DEAD))
                layout = Layout.whole(run_id, self._stored(run_id, buckets), buckets)
            else:
                layout = self._write_piece(run_id, before, last, rows, work, dead_share, most_pieces)
            self._write_tombs(run_id, before, last, still_open)
        self.commit(run_id, "compact", "compact", covers=covers, layout=layout)
        return run_id

    def _write_piece(
        self,
        run_id: int,
        before: Layout,
        last: DataFrame,
        rows: DataFrame,
        work: WorkTables,
        dead_share: float,
        most_pieces: int,
    ) -> Layout:
        bucket = bucket_of(before.buckets)
        gone = work.keep(
            self._base(before).select(*KEY).join(last.select(*KEY), KEY, "left_semi").withColumn("bucket", bucket)
        )
        added = last.filter("op = 'index'").withColumn("bucket", bucket)
        new, dead = (before.per_bucket(x.groupBy("bucket").count().collect()) for x in (added, gone))
        anew = before.to_rewrite(new, dead, dead_share)
        merged = before.pieces[1:] if len(before.pieces) >= most_pieces else ()
        parts = []
        for piece in before.pieces:
            wanted = before.used(piece, anew)
            if wanted:
                parts.append(self._alive(self._bucket_files(piece, wanted), before, piece))
        if merged:
            parts.append(self._base(before, merged).withColumnRenamed("run_id", "of_run").filter(~bucket.isin(anew)))
        gone = gone.filter(~F.col("bucket").isin(anew)).select(*KEY)
        for part in parts:
            rows = rows.unionByName(untouched(part.withColumnRenamed("of_run", "run_id"), last), allowMissingColumns=True)
        first = before.pieces[0]
        if merged:
            # Of the keys that died in any piece, those of the oldest, which stays.
            oldest = before.counted(self._state_table(first, before.buckets), first).filter(~bucket.isin(anew))
            gone = oldest.select(*KEY).join(gone.unionByName(self._dead(list(merged))), KEY, "left_semi")
        self._write_state(run_id, rows, before.buckets)
        self._write("dead", run_id, gone)
        if not merged:
            return before.extended(run_id, new, dead, anew)
        layout = before.merged(run_id, anew)
        oldest = layout.counted(self._state_table(first, before.buckets), first)
        stored, lost = (
            before.per_bucket(x.groupBy(bucket.alias("bucket")).count().collect()) for x in (oldest, self._dead([run_id]))
        )
        here = self._stored(run_id, before.buckets)
        return layout.sized([a + b for a, b in zip(stored, here, strict=True)], lost)

    def _write_state(self, run_id: int, rows: DataFrame, buckets: int) -> None:
        state = rows.withColumnRenamed("run_id", "of_run").select(*STATE.fieldNames()).repartition(buckets, *KEY)
        name = f"docsnap_written_{uuid.uuid4().hex}"
        state.write.bucketBy(buckets, *KEY).option("path", self._path("state", run_id)).saveAsTable(name)
        self.spark.sql(f"drop table {name}")  # its files stay

    def _stored(self, run_id: int, buckets: int) -> list[int]:
        """Documents of a piece, by bucket; reads keys only."""
        counts = self._state_table(run_id, buckets).groupBy(bucket_of(buckets).alias("bucket")).count().collect()
        return Layout.counts(counts, buckets)

    def _bucket_files(self, piece: int, wanted: list[int]) -> DataFrame:
        """The documents of some buckets of a piece; no other file is opened."""
        files, target = filesystem(self.spark, self._path("state", piece))
        names = [entry.getPath().toString() for entry in files.listStatus(target)]
        chosen = [name for name in names if Layout.bucket_of_file(name) in set(wanted)]
        reader = self.spark.read.schema(STATE)
        return reader.parquet(*chosen) if chosen else self.spark.createDataFrame([], STATE)

    def _write(self, table: str, run_id: int, rows: DataFrame) -> None:
        rows.select(*TABLES[table].fieldNames()).write.mode("overwrite").parquet(self._path(table, run_id))

    def _write_tombs(self, run_id: int, before: Layout | None, last: DataFrame, still_open: list[int]) -> None:
        """Deletions above the lowest id that is claimed and not committed; usually none."""
        tombs = last.filter("op = 'delete'").withColumnRenamed("run_id", "of_run").select(*TOMBS.fieldNames())
        if before is not None:
            tombs = tombs.unionByName(self._tombs(before.run_id))
        low = min(still_open, default=None)
        self._write("tombs", run_id, tombs.limit(0) if low is None else tombs.filter(F.col("of_run") > low))

    def prune(self, keep: int = 2) -> None:
        """Delete what no read needs: all but the last ``keep`` states, the last ``keep`` snapshots
        of each job, and the log, responses and commits that a kept state covers.

        Of each source the last commit stays, so that a repeated batch is still known.
        """
        commits = self._read("commits")
        by_job = Window.partitionBy("job").orderBy(F.desc("run_id"))
        crawls = commits.filter(F.col("kind") == "crawl").withColumn("n", F.row_number().over(by_job))
        kept_snapshots = {row[0] for row in crawls.filter(F.col("n") <= keep).select("run_id").collect()}
        self._delete("snapshot", lambda n: n not in kept_snapshots)
        states = [r for r in commits.filter(F.col("kind") == "compact").orderBy(F.desc("run_id")).limit(keep).collect()]
        if len(states) < keep:
            return
        oldest = states[-1]
        pieces = {n for state in states for n in (state["pieces"] or [state["run_id"]])}
        for run_id in self._ids("state"):
            if 0 < run_id < states[0]["run_id"] and run_id not in pieces:
                self.spark.sql(f"drop table if exists {self._state_name(run_id)}")
        for table in ("state", "dead", "tombs"):
            self._delete(table, lambda n: n < states[0]["run_id"] and n not in pieces)
        covered = set(oldest["covers"])
        committed = set(self._ids("commits"))
        # Covered, or claimed before the oldest kept state and never committed.
        gone = {n for n in self._ids("ops") if n in covered or (n < oldest["run_id"] and n not in committed)}
        for table in ("ops", "responses"):
            self._delete(table, gone.__contains__)
        last = {row[0] for row in commits.groupBy("source").agg(F.max("run_id")).select(F.col("max(run_id)")).collect()}
        needed = kept_snapshots | last | {r["run_id"] for r in states}
        self._delete("commits", lambda n: n in covered and n not in needed)
        self._delete("claims", lambda n: n in covered)

    def _delete(self, table: str, unwanted: Callable[[int], bool]) -> None:
        for run_id in self._ids(table):
            if run_id > 0 and unwanted(run_id):
                files, target = filesystem(self.spark, self._path(table, run_id))
                files.delete(target, True)
