"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sheaf", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage into the cluster's shared folder.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a local session that
    names none gets a temporary one; on a cluster a machine-local folder would not survive the
    loss of an executor, so there the missing setting is an error.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Like :func:`checkpoint`, as a written table: texts are compressed, and a reader of other columns
    leaves them alone. Spark deletes it when the driver ends.

    Row groups are small and looked at after each row, so that neither side holds many texts at once.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    df.write.options(**{
        "parquet.block.size": 16 * 1024 * 1024, "parquet.page.size.row.check.min": 1,
    }).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            shared = tempfile.mkdtemp(prefix="sheaf-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def deal_out(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over all shuffle partitions before work that costs far more than moving them.

    The number is given explicitly, because otherwise small inputs are merged into few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
