"""The folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a folder of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            import tempfile

            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="candlewick-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, for whatever store Spark can reach."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def free_name(columns: list[str], stem: str) -> str:
    """A column name that columns don't have, whatever their case."""
    taken = {c.lower() for c in columns}
    return next(x for x in (f"{stem}{k or ''}" for k in range(len(columns) + 1)) if x not in taken)


#: Makes Spark remove an execution's shuffle files at its end.
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written once to the shared folder and read again from there by whoever needs them.

    They go when dropped, or else with the application: results read them lazily.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        p, fs = hadoop_path(spark, self.at)
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        # nothing reads the shuffles of this plan once its table is written
        before = self.spark.conf.get(_REMOVE_SHUFFLES, "false")
        self.spark.conf.set(_REMOVE_SHUFFLES, "true")
        try:
            df.write.parquet(path := f"{self.at}/{name}")
        finally:
            self.spark.conf.set(_REMOVE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            p, fs = hadoop_path(self.spark, f"{self.at}/{name}")
            fs.delete(p, True)
