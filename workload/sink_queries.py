"""Writers and readers: every query writes a table to the shared folder, reads it and compares."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import content as C
from sheaf.operators import catalog as K
from sheaf.operators import diff as D
from sheaf.operators import extract as X
from sheaf.plans import formatting as W
from sheaf.sources import filetree, sinks
from sheaf.sources.blocks import read_bundles_text
from sheaf.streaming import extraction as T
from workload import bundle_queries as B
from workload import catalog_queries as Q
from workload import files_queries as L
from workload import inputs as I
from workload.log_queries import _work_folder
from workload.registry import query


def _local(folder: str) -> str:
    return folder.removeprefix("file://")


@query("extract_files", f"""
WITH {B._CLAIMS}, w AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, target ORDER BY entry_idx DESC) AS r FROM t WHERE NOT unsafe AND NOT broken)
SELECT bundle_id || '/' || target AS path, {B._PAYLOAD} AS content FROM w WHERE r = 1""")
def extract_files(spark, sf):
    """An extraction carried out: the files that are there afterwards."""
    root = _local(_work_folder(spark))
    plan = X.plan_extraction(B._to_extract(spark, sf), B._existing(spark, sf), "overwrite", add_headers=False)
    sinks.write_actions(spark, plan, root)
    found = filetree.read_contents(filetree.discover_files(spark, root, deny=[]))
    return found.select("path", C.file_checksum(F.col("content")).alias("content"))


@query("bundle_files", f"""
WITH {B._ENTRY_SQL} SELECT bundle_id, sha256(string_agg({B._FENCE_TEXT}, chr(10) || chr(10) ORDER BY turn)) AS text_sum FROM e GROUP BY 1""")
def bundle_files(spark, sf):
    """Fence bundles written block by block over many tasks; the files of a bundle add up to it."""
    root = _local(_work_folder(spark))
    sinks.write_blocks_text(spark, W.format_blocks(I.turn_entries(spark, sf), "md_fence"), root, "\n\n")
    parts = read_bundles_text(spark, root).select(
        F.substring_index("bundle_id", "/", 1).alias("bundle_id"), F.substring_index("bundle_id", "/", -1).alias("part"), "text")
    whole = parts.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return whole.select("bundle_id", C.text_checksum(text).alias("text_sum"))


@query("log_round_trip", """
SELECT event_id::VARCHAR AS session_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp,
CASE event_id % 5 WHEN 1 THEN NULL ELSE event_type END AS event,
CASE event_id % 5 WHEN 2 THEN NULL WHEN 3 THEN 'no json: ' || event_type ELSE event_type END AS details FROM events""")
def log_round_trip(spark, sf):
    """Events written as JSON lines and read back, with null fields and details that are no JSON."""
    path = _work_folder(spark)
    kind = F.col("event_id") % 5
    log = I.load(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("sessionId"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(kind != 1, F.col("event_type")).alias("event"),
        F.when(kind == 3, F.concat(F.lit("no json: "), "event_type"))
        .when(kind != 2, F.to_json(F.struct(F.col("event_type").alias("k")))).alias("details"),
    )
    sinks.append_log(log, path)
    details = F.coalesce(F.get_json_object("details", "$.k"), F.col("details"))
    return sinks.read_log(spark, path).select(
        F.col("sessionId").alias("session_id"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        "event", details.alias("details"))


@query("catalog_round_trip", f"""
WITH {Q._SOURCES}, f AS (SELECT file, count(*) AS functions FROM m GROUP BY 1)
SELECT src.file, doc_id % 17 IN (3, 9) AS failed, coalesce(functions, 0) AS functions,
CASE WHEN doc_id % 17 IN (3, 9) THEN 0 ELSE 5 + 5 * functions END AS commands FROM src LEFT JOIN f USING (file)""")
def catalog_round_trip(spark, sf):
    """Catalog rows written as JSON and read back."""
    path = _work_folder(spark)
    sinks.write_catalog(K.build_catalog(I.sources(spark, sf)), path)
    return sinks.read_catalog(spark, path).select(
        "file", F.col("error").isNotNull().alias("failed"),
        F.coalesce(F.size("functions"), F.lit(0)).cast("bigint").alias("functions"),
        F.coalesce(F.size("commands"), F.lit(0)).cast("bigint").alias("commands"))


@query("changelog_csv", f"""
WITH {Q.CHANGES} SELECT file_old, change_type, scope, coalesce(line_old::INT::VARCHAR, '') AS line_old, coalesce(line_new::INT::VARCHAR, '') AS line_new FROM changes""")
def changelog_csv(spark, sf):
    """The changelog written as CSV and read back."""
    from sheaf.schemas import CHANGE_COLUMNS

    path = _work_folder(spark)
    sinks.write_changelog(D.changelog(Q._changes(spark, sf), "path"), path)
    schema = ", ".join(f"{c} {'int' if c.startswith(('line', 'pos')) else 'string'}" for c in CHANGE_COLUMNS)
    back = spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True)
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("line_old", "line_new")]
    return back.select("file_old", "change_type", "scope", *shown)


@query("folder_digests", f"""
SELECT 'doc_' || doc_id AS path, sha256({I.check_sql(I.FILE_BYTES)}) AS sha256, octet_length({I.check_sql(I.FILE_BYTES)}) AS length FROM documents""")
def folder_digests(spark, sf):
    """Every document a file of one folder; names, sizes and checksums of what lies there."""
    root = _stored(spark, sf)
    found = filetree.digest_files(filetree.discover_files(spark, root, deny=[]))
    return found.select("path", "sha256", F.when(F.col("n_read") == F.col("length"), F.col("length")).alias("length"))


@query("sniff_stored", f"""
WITH {L.FILES} SELECT 'doc_' || doc_id AS path, is_binary FROM sniffed""")
def sniff_stored(spark, sf):
    """Files told apart by their heads, before any content is read."""
    root = _stored(spark, sf)
    return filetree.sniff_files(filetree.discover_files(spark, root, deny=[])).select("path", "is_binary")


def _stored(spark, sf):
    root = _local(_work_folder(spark))
    docs = I.load(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("target"), F.expr(I.spark_sql(I.FILE_BYTES)).alias("payload"))
    sinks.write_files(spark, docs, root)
    return root


@query("stream_extract_rename", B._RENAME_SQL)
def stream_extract_rename(spark, sf):
    """The entries of every bundle arrive in three deliveries; numbers go on where the last one stopped."""
    work = _work_folder(spark)
    entries = B._to_extract(spark, sf)
    third = F.least(F.expr("entry_idx DIV 3"), F.lit(2))
    for delivery in range(3):
        entries.filter(third == delivery).write.mode("append").parquet(f"{work}/in")
        arriving = spark.readStream.schema(entries.schema).parquet(f"{work}/in")
        T.extract_stream(arriving, B._existing(spark, sf), f"{work}/out", f"{work}/state", add_headers=False).awaitTermination()
    return B._shown_actions(T.planned_actions(spark, f"{work}/out")).drop("path", "payload")
