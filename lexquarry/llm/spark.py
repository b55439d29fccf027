"""What the operators ask of the session: a shared folder for cut lineage, and Arrow batches of a bounded size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: whichever comes first ends it (one text may be larger).
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def prepare(spark: SparkSession) -> None:
    """Sets what is unset: the checkpoint folder (in the warehouse, which the cluster shares, and only where it names none) and the size of Arrow batches.

    The batch size holds for the session from then on: results are computed later, by the caller's action.
    """
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints/{uuid.uuid4()}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        sc.setCheckpointDir(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = int(spark.conf.get(name).lower().removesuffix("b"))
        if not 0 < have <= most:
            spark.conf.set(name, str(most))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder; it outlives lost executors."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written as a compressed table in the shared checkpoint folder, until dropped() or the end: for wide or many rows.

    What it was shuffled through is removed at once, since nothing reads it again.
    """
    spark = df.sparkSession
    prepare(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    with conf(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path.toString())
    out = spark.read.parquet(path.toString())
    out._folder = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes what kept() wrote."""
    df._folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(df._folder, True)


@contextmanager
def conf(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows to be joined to texts are broadcast up to so many bytes (two numbers a row, and its lists); more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, *arrays: str) -> DataFrame:
    """df, kept, and marked for a broadcast if its size allows it. arrays: its list columns of numbers."""
    df = cut(df)
    size = df.agg(F.sum(F.lit(48) + sum((4 * F.size(a) for a in arrays), F.lit(0)))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
