"""Shared folders, intermediate tables and small helpers of the llm operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that Spark hands to a Python worker at once. A batch lies in the executor's direct memory more
#: than once and in the worker's again, all beside the heap; by itself Spark stops at 64 MB or 10,000 rows.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, where it has no bound of its own.

    The bound is read when a plan runs, which is after its operator has returned; so it stays.
    """
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset on one machine (tests) a temporary folder is made and set; on a cluster
    that would be a folder which the executors don't see, so an unset one is an error there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(where)
    return where


class Scratch:
    """Intermediate Parquet tables of one run in the shared folder.

    A written table cuts the lineage and survives the loss of executors. Tables
    that no later step reads are dropped as soon as that is known. What a result still reads
    stays until clear(), which a pipeline calls once the result is written, or the program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        atexit.register(self._at_exit)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """A table dealt by its keys in as many buckets as shuffles have partitions.

        Later joins on the keys read it without moving it again.
        """
        self.tables.append(name)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(buckets, *keys).option("path", self.path(name)).saveAsTable(self._name(name))
        return self.spark.table(self._name(name))

    def drop_bucketed(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {self._name(name)}")
            self.tables = [x for x in self.tables if x != name]
        self.drop(*names)

    def clear(self) -> None:
        """Everything goes."""
        self.drop_bucketed(*self.tables)
        self.drop("")
        atexit.unregister(self._at_exit)

    def _at_exit(self) -> None:
        # a session that has ended takes no more calls
        with contextlib.suppress(Exception):
            self.clear()

    def _name(self, name: str) -> str:
        return f"{name}_{self.root.rpartition('-')[2]}"

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
