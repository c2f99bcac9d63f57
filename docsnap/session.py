"""Session settings the jobs rely on, and the shared folder for intermediate tables."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession

logger = logging.getLogger(__name__)

LOCAL_FOLDER = "/tmp/checkpoints"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lets the runtime use a hash join after a shuffle where the partitions proved small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Call sites in error messages cost several round trips per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "docsnap", **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` uses ``__`` for dots in option names."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Only where driver and executors are one process does a session without that setting get a
    fixed folder of this machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        logger.warning("spark.checkpoint.dir is unset: %s of this machine takes its place", LOCAL_FOLDER)
        folder = LOCAL_FOLDER
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder so that every reader sees them alike."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def filesystem(spark: SparkSession, location: str):
    """The Hadoop file system of a location, and the location as its path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


class WorkTables:
    """Intermediate tables of one run in the shared folder, deleted when the run is over.

    Unlike a checkpoint, a written table has a size the planner knows, so a join with it is
    broadcast only if it is small.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.location = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
        self.tables = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        place = f"{self.location}/{self.tables}"
        df.write.parquet(place)
        return self.spark.read.schema(df.schema).parquet(place)

    def __enter__(self) -> WorkTables:
        return self

    def __exit__(self, *_) -> None:
        files, target = filesystem(self.spark, self.location)
        files.delete(target, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, items: int, per_task: int) -> int:
    """Tasks for that many items: more than the shuffle width only where each has a full load."""
    return max(1, min(items, max(shuffle_width(spark), -(-items // per_task))))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a scan over all cores where it comes in fewer pieces than that.

    Dealt by the keys of a later grouping, it saves that one its own shuffle.
    For steps that cost much per row on small or badly split inputs; a scan with enough
    pieces is returned as it is. Not for plans that shuffle: counting their pieces runs them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
