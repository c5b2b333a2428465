"""Bundle files as rows: whole, or in slices of lines, one file over many tasks.

Slices come from Spark's own text source, which divides a file into splits and gives each line to
one of them. A slice is ordered by the byte at which its split starts and by the lines of the split
before it, so the slices of a file are the parts of a bundle for ``plans.parsing``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.content import decode_ignore
from sheaf.functions.paths import base_name, relative_to
from sheaf.functions.text import universal_newlines
from sheaf.sources.filetree import list_files, read_contents

SLICE_BYTES = 1 << 20


def _below(spark: SparkSession, root: str) -> Column:
    """The path of ``file_path`` below the root; the name of a single file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    plain = F.url_decode(F.regexp_replace("file_path", r"\+", "%2B"))
    # A local path can be written with one or with three slashes after its scheme.
    one = F.regexp_replace(plain, "^file:/+", "file:/")
    root_one = full.replace("file:///", "file:/")
    return F.when(one == root_one, F.substring_index(one, "/", -1)).otherwise(F.substring(one, len(root_one) + 2, 1 << 30))


def read_slices(spark: SparkSession, path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``bundle_id, part_no, text``: the files below a path of any Hadoop file system, in slices of whole
    lines of about ``slice_bytes``; a longer line is a slice of its own, an empty file has none.
    Undecodable bytes are dropped.

    ``part_no`` rises with the place in the file. A split starts behind its first byte, with the first
    line that begins there, so one more than its first byte is no larger than the place of any line.
    """

    def sliced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, lines, size, at = None, [], 0, 0

        def done() -> pd.DataFrame:
            text = b"\n".join(lines) + b"\n"
            return pd.DataFrame({
                "file_path": [file[0]], "part_no": [file[1] + at + (file[1] > 0)], "n_bytes": [size], "file_size": [file[2]],
                "text": [text.decode("utf-8", "ignore")]})

        for frame in frames:
            for *key, value in zip(frame["file_path"], frame["start"], frame["file_size"], frame["line"]):
                if lines and (key != file or size >= slice_bytes):
                    yield done()
                    at, lines, size = at + size, [], 0
                if key != file:
                    file, at = key, 0
                lines.append(bytes(value))
                size += len(value) + 1
        if lines:
            yield done()

    below = _below(spark, path)
    files = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    lines = files.text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("file_size"), F.col("value").cast("binary").alias("line"))
    slices = lines.mapInPandas(sliced, "file_path string, part_no bigint, n_bytes bigint, file_size bigint, text string")
    # The source does not tell whether the last line ends in a line feed; the size does.
    ends = slices.groupBy("file_path").agg(F.max("part_no").alias("last"), F.sum("n_bytes").alias("sum"))
    open_end = (F.col("part_no") == F.col("last")) & (F.col("sum") > F.col("file_size"))
    text = F.when(open_end, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    return slices.join(ends, "file_path").select(below.alias("bundle_id"), "part_no", text.alias("text"))


def read_bundles_text(spark: SparkSession, path: str, newline_text: bool = False) -> DataFrame:
    """``bundle_id, text``: one row per bundle file, empty ones included; undecodable bytes are
    dropped. ``bundle_id`` is the path below ``path``, or the name of a single file."""
    files = read_contents(list_files(spark, path))
    text = decode_ignore(F.col("content"))
    below = relative_to(F.col("abs_path"), os.path.abspath(path))
    return files.select(
        F.when(below == ".", base_name(F.col("abs_path"))).otherwise(below).alias("bundle_id"),
        (universal_newlines(text) if newline_text else text).alias("text"),
    )
