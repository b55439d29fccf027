"""A session with the settings the engine is meant for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lexquarry", **conf: str) -> SparkSession:
    """conf: further settings, with __ for dots."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that spark.checkpoint.dir names, or, where it names none, one in the warehouse until the end."""
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints/{uuid.uuid4()}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        sc.setCheckpointDir(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once by checkpoint()."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once, as compressed columns in the checkpoint folder until the session ends: for rows of texts and lists, which checkpoint() writes several times as large."""
    spark = df.sparkSession
    folder = f"{_folder(spark)}/stored-{uuid.uuid4()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, key: str, *, rows: int = 5_000) -> DataFrame:
    """df dealt by key to tasks of about so many rows: for small rows that much is made of, which a scan would leave to few tasks."""
    return df.repartition(max(1, -(-df.count() // rows)), key)
