"""Session settings and the checkpoint rule shared by the iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Pages are wide rows: small scan splits and small Arrow batches keep a task's
# working set bounded however large single pages get.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Call-site capture costs more than planning does on ladders of many small expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(master: str | None = None, app: str = "rosterline", **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="rosterline-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store_bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write once as a Parquet table bucketed by ``key``, next to the checkpoints.

    Cuts lineage like a checkpoint, but later reads take only the columns they need and
    joins on ``key`` leave this side where it is.
    """
    spark = df.sparkSession
    name = f"rosterline_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    stored = spark.table(name)
    # The files are what is used from here on; the catalog keeps no trace of them.
    spark.sql(f"DROP TABLE {name}")
    return stored


class BucketedTable:
    """A Parquet table bucketed by ``keys`` that grows by appends: joins on these keys leave it where it is.

    Rows are appended one file per bucket, by fewer tasks than buckets where they are few. ``frame`` is null before the first append; ``close`` takes the table out of the
    catalog, its files and frames over them stay.
    """

    def __init__(self, spark: SparkSession, *keys: str):
        self.spark, self.keys = spark, keys
        self.name = f"rosterline_{uuid.uuid4().hex}"
        self.path = f"{ensure_checkpoint_dir(spark)}/{self.name}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.frame: DataFrame | None = None

    def append(self, df: DataFrame) -> None:
        same = int(self.spark.conf.get("spark.sql.shuffle.partitions")) == self.buckets
        # Partitions are buckets then, and adaptive execution may merge but not split them.
        placed = df.repartition(*self.keys) if same else df.repartition(self.buckets, *self.keys)
        placed.write.format("parquet").mode("append").option("path", self.path).bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        self.frame = self.spark.table(self.name)

    def close(self) -> DataFrame | None:
        if self.frame is not None:
            self.spark.sql(f"DROP TABLE {self.name}")
        return self.frame
