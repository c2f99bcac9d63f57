"""The operations of a store as a stream, for those who keep something in step with it.

    spark.dataSource.register(OperationsSource)
    spark.readStream.format("operations").option("location", "/shared/store").load()

An offset names the runs that were committed: all up to a number but for those still missing then. So a
run that is committed late is delivered late, every committed run once, also over restarts and compactions.
Only what ``prune`` has deleted can no longer be read; a stream that needs it fails.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from docsnap.schema import OPS

SCHEMA = T.StructType([*OPS.fields, T.StructField("run_id", T.LongType())])


@dataclass
class OperationsFile(InputPartition):
    path: str
    run_id: int


class OperationsReader(DataSourceStreamReader):
    def __init__(self, location: str) -> None:
        self.location = location if "://" in location else "file://" + location.removeprefix("file:")

    def _store(self) -> tuple[FileSystem, str]:
        files, place = FileSystem.from_uri(self.location)
        return files, place.rstrip("/")

    def _committed(self) -> set[int]:
        """Runs whose commit has been written to its end."""
        files, place = self._store()
        found = files.get_file_info(FileSelector(f"{place}/commits", recursive=True))
        done = [x.path.split("/")[-2] for x in found if x.base_name == "_SUCCESS"]
        return {int(name.split("=")[1]) for name in done if name.startswith("run_id=")} - {0}

    @staticmethod
    def _named(offset: dict) -> set[int]:
        return set(range(1, offset["up_to"] + 1)) - set(json.loads(offset["missing"]))

    def initialOffset(self) -> dict:
        return {"up_to": 0, "missing": "[]"}

    def latestOffset(self) -> dict:
        committed = self._committed()
        up_to = max(committed, default=0)
        return {"up_to": up_to, "missing": json.dumps(sorted(set(range(1, up_to + 1)) - committed))}

    def partitions(self, start: dict, end: dict) -> list[OperationsFile]:
        files, place = self._store()
        parts = []
        # Pruned commits count as missing; what was delivered before is not asked for again.
        for run_id in sorted(self._named(end) - self._named(start)):
            found = files.get_file_info(FileSelector(f"{place}/ops/run_id={run_id}"))
            parts += [OperationsFile(x.path, run_id) for x in found if x.type == FileType.File and x.extension == "parquet"]
        return parts

    def read(self, part: OperationsFile) -> Iterator[pa.RecordBatch]:
        files, _ = self._store()
        # Times of a store are in UTC.
        schema = to_arrow_schema(SCHEMA)
        names = OPS.fieldNames()
        with files.open_input_file(part.path) as handle:
            for batch in pq.ParquetFile(handle).iter_batches(batch_size=1000, columns=names):
                columns = [batch[name].cast(schema.field(name).type) for name in names]
                columns.append(pa.repeat(pa.scalar(part.run_id, pa.int64()), batch.num_rows))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


class OperationsSource(DataSource):
    """Option: ``location``, the folder of the store."""

    @classmethod
    def name(cls) -> str:
        return "operations"

    def schema(self) -> T.StructType:
        return SCHEMA

    def streamReader(self, schema) -> OperationsReader:
        return OperationsReader(self.options["location"])
