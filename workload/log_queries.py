"""Session events, in batch and as streams."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from sheaf.streaming import events as E
from sheaf.streaming import sessions as S
from workload import inputs as I
from workload.registry import query


@query("session_summary", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(s.user_id AS VARCHAR) AS session_id, strftime(s.a, '%Y-%m-%d %H:%M:%S.%f') AS start_time, strftime(s.b, '%Y-%m-%d %H:%M:%S.%f') AS end_time,
s.n AS total_events, (SELECT string_agg(event_type || '=' || c.n, ',' ORDER BY event_type) FROM c WHERE c.user_id = s.user_id) AS event_counts FROM s""")
def session_summary(spark, sf):
    return _flat(E.session_summary(I.log(spark, sf)))


def _flat(summary):
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    counts = F.transform(
        F.map_entries("eventCounts"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return summary.select(
        F.col("sessionId").alias("session_id"), F.date_format("startTime", stamp).alias("start_time"),
        F.date_format("endTime", stamp).alias("end_time"), F.col("totalEvents").alias("total_events"),
        F.array_join(F.array_sort(counts), ",").alias("event_counts"),
    )


@query("event_counts", """
SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS event, count(*) AS n FROM events GROUP BY 1, 2""")
def event_counts(spark, sf):
    return E.event_counts(I.log(spark, sf)).select(F.col("sessionId").alias("session_id"), "event", "n")


@query("event_field", """
SELECT event_type AS event, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def event_field(spark, sf):
    return I.log(spark, sf).groupBy("event", E.field("$.k", "bigint").alias("k")).agg(
        F.count("*").alias("n")
    )


_DETAILS = {
    "operation_start": """'{"mode":"bundle","profile":' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '"md_fence"' END || ',"source":"s' || user_id || '","destination":"out"}'""",
    "operation_complete": """'{"mode":"bundle","profile":"md_fence","source":"s","destination":"out","counts":{"processed":' || user_id || ',"added":' || user_id || ',"skipped":1,"failed":2,"errors":2},"checksumsVerified":true,"elapsedMs":' || event_id || '}'""",
    "error": """'{"mode":"bundle","profile":null,"source":"s","errorMessage":"","errorType":"IOError","filePath":"p' || event_id || '"}'""",
    "warning": """'{"message":"w' || event_id || '","context":{}}'""",
    "profile_detected": """'{"detectedProfile":"md_fence","attemptedProfiles":["plain_marker","md_fence"],"confidence":"high"}'""",
    "file_processed": """'{"filePath":"p","encoding":"utf-8","eolStyle":"LF","isBinary":false,"sizeBytes":' || event_id || '}'""",
    "checksum_verified": """'{"filePath":"p","verified":true,"expected":null,"actual":"a' || event_id || '"}'""",
}
_CASES = " ".join(
    f"WHEN {i} THEN {sql.replace('event_id', 'CAST(event_id AS VARCHAR)').replace('|| user_id', '|| CAST(user_id AS VARCHAR)').replace('CAST(event_id AS VARCHAR) %', 'event_id %')}"
    for i, sql in enumerate(_DETAILS.values())
)
_NAMES = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(_DETAILS))


@query("event_envelope", f"""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, CAST(user_id AS VARCHAR) AS session_id, CASE event_id % 7 {_NAMES} END AS event, CASE event_id % 7 {_CASES} END AS details FROM events""")
def event_envelope(spark, sf):
    e = I.load(spark, sf, "events")
    bundle, fence, s = F.lit("bundle"), F.lit("md_fence"), F.lit("s")
    null = F.lit(None).cast("string")
    eid, uid = F.col("event_id"), F.col("user_id")

    def numbered(prefix):
        return F.concat(F.lit(prefix), eid.cast("string"))

    built = [
        E.start_details(bundle, F.when(eid % 2 != 0, fence), F.concat(s, uid.cast("string")), F.lit("out")),
        E.complete_details(bundle, fence, s, F.lit("out"), uid, F.lit(1), F.lit(2), F.lit(True), eid),
        E.error_details(bundle, null, s, null, F.lit("IOError"), numbered("p")),
        E.warning_details(numbered("w")),
        E.detected_details(fence, F.array(F.lit("plain_marker"), fence)),
        E.processed_details(F.lit("p"), F.lit("utf-8"), F.lit("LF"), F.lit(False), eid),
        E.checksum_details(F.lit("p"), F.lit(True), null, numbered("a")),
    ]
    kind = eid % 7
    details = F.coalesce(*[F.when(kind == i, d) for i, d in enumerate(built)])
    names = F.array(*[F.lit(n) for n in _DETAILS])
    log = E.log_events(e, uid, F.element_at(names, (kind + 1).cast("int")), details, F.col("ts"))
    return log.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("sessionId").alias("session_id"), "event", "details",
    )


def _work_folder(spark) -> str:
    """A new folder below the cluster's shared one; a temporary folder only for a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        return tempfile.mkdtemp(prefix="sheaf-stream-")
    import uuid

    return os.path.join(shared, f"stream-{uuid.uuid4().hex}")


@query("stream_session_counts", """
SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS event, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_session_counts(spark, sf):
    """The event table drained as a stream into running counts."""
    work = _work_folder(spark)
    stream = (
        I.arriving(spark, sf, "events")
        .select(
            F.col("user_id").cast("string").alias("sessionId"), F.col("ts").cast("timestamp").alias("timestamp"),
            F.col("event_type").alias("event"), F.col("props").alias("details"),
        )
    )
    E.run_available(E.stream_event_counts(stream), f"{work}/out", f"{work}/state").awaitTermination()
    return spark.read.parquet(f"{work}/out").select(F.col("sessionId").alias("session_id"), "event", "n")


@query("stream_validate", """
SELECT conv_id || '/' || turn AS bundle_id, turn % 3 <> 0 AS valid, CASE WHEN turn % 3 <> 0 THEN 1::BIGINT ELSE 0 END AS file_count FROM conversations""")
def stream_validate(spark, sf):
    """Each turn arrives as a bundle of its own; a third of them hold no marker."""
    work = _work_folder(spark)
    stream = (
        I.arriving(spark, sf, "conversations")
        .select(
            F.expr("CAST(conv_id AS STRING) || '/' || CAST(turn AS STRING)").alias("bundle_id"),
            F.expr("CASE WHEN turn % 3 = 0 THEN text ELSE '# FILE: a.md' || chr(10) || text END").alias("text"),
        )
    )
    E.validate_stream(stream, f"{work}/out", f"{work}/state").awaitTermination()
    return spark.read.parquet(f"{work}/out").select("bundle_id", "valid", "file_count")


_GAP, _LATE = 43_200, 3_600


@query("stream_ended_sessions", f"""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL {_GAP} SECOND THEN 0 ELSE 1 END AS opens FROM events),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g),
c AS (SELECT user_id, run, event_type, count(*) AS n FROM n GROUP BY ALL),
s AS (SELECT user_id, run, min(ts) AS a, max(ts) AS b, count(*) AS n FROM n GROUP BY ALL)
SELECT CAST(s.user_id AS VARCHAR) AS session_id, strftime(s.a, '%Y-%m-%d %H:%M:%S.%f') AS start_time, strftime(s.b, '%Y-%m-%d %H:%M:%S.%f') AS end_time,
s.n AS total_events, (SELECT string_agg(event_type || '=' || c.n, ',' ORDER BY event_type) FROM c WHERE c.user_id = s.user_id AND c.run = s.run) AS event_counts
FROM s WHERE b + INTERVAL {_GAP + _LATE} SECOND <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)""")
def stream_ended_sessions(spark, sf):
    """Half a day without an event ends a user's session; the table is drained as a stream, and every
    session that its watermark has ended is summed up once."""
    work = _work_folder(spark)
    stream = (
        I.arriving(spark, sf, "events")
        .select(F.col("user_id").cast("string").alias("sessionId"), F.col("ts").cast("timestamp").alias("timestamp"),
                F.col("event_type").alias("event"))
    )
    S.run_sessions(S.ended_sessions(stream, _GAP, f"{_LATE} seconds"), f"{work}/out", f"{work}/state").awaitTermination()
    return _flat(spark.read.parquet(f"{work}/out"))
