"""Tables that already hold texts, read as if they were files, bundles or logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_files(df: DataFrame, bundle_id: Column, path: Column, content: Column) -> DataFrame:
    data = content.cast("binary")
    return df.select(
        bundle_id.cast("string").alias("bundle_id"), path.alias("path"), path.alias("abs_path"),
        F.octet_length(data).cast("bigint").alias("length"), data.alias("content"),
    )


def as_entries(df: DataFrame, bundle_id: Column, entry_idx: Column, path: Column, content: Column,
               eol_style: Column) -> DataFrame:
    return df.select(
        bundle_id.cast("string").alias("bundle_id"), entry_idx.cast("bigint").alias("entry_idx"),
        path.alias("path"), content.alias("content"),
        F.lit("utf-8").alias("encoding"), F.lit(False).alias("is_binary"),
        eol_style.alias("eol_style"), F.lit(None).cast("string").alias("checksum"),
        F.octet_length(content).cast("bigint").alias("file_size_bytes"),
        F.lit(None).cast("string").alias("content_type"),
    )


def as_log(df: DataFrame, session: Column, timestamp: Column, event: Column,
           details: Column) -> DataFrame:
    return df.select(
        session.cast("string").alias("sessionId"), timestamp.cast("timestamp").alias("timestamp"),
        event.alias("event"), details.alias("details"),
    )
