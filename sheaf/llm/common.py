"""What the operators of this subpackage share: tables, intermediate tables, words, the registry."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}

#: ASCII white space, as a character class for Java and Python patterns alike.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Characters of text that a task works on at once, beyond one document.
SLICE_CHARS = 4_000_000


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session that names none gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        folder = _LOCAL_FOLDERS.setdefault(app, "") or tempfile.mkdtemp(prefix="sheaf-llm-")
        _LOCAL_FOLDERS[app] = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path for an intermediate table; Spark deletes it when the driver ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it again: it cuts the lineage,
    is computed once, and outlives any executor."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids up to this number (8 bytes each, so 32 MB) may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def small_side(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """A written table, marked for broadcast if its rows, counted first, are within the bound. A join
    with few rows then does not shuffle the texts on its other side."""
    return F.broadcast(df) if df.count() <= rows else df


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null: starts of runs of characters that are not white space."""
    starts = F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]"))
    return F.coalesce(starts, F.lit(0)).cast("long")


def slices(frames: Iterator[pd.DataFrame], column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pd.DataFrame]:
    """The same rows in frames of bounded text; a longer text is a frame of its own."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = pd.Series([len(t) if t else 0 for t in frame[column]], dtype="int64")
        part = sizes.cumsum() // chars
        if part.iloc[-1] == 0:
            yield frame
        else:
            for _, own in frame.groupby(part.values, sort=True):
                yield own
