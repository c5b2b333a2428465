"""Session events: building them, summing them up in batch or as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheaf import schemas
from sheaf.functions.content import decode_ignore

# Event names.
OPERATION_START = "operation_start"
OPERATION_COMPLETE = "operation_complete"
ERROR = "error"
WARNING = "warning"
VALIDATION = "validation"
PROFILE_DETECTED = "profile_detected"
FILE_PROCESSED = "file_processed"
CHECKSUM_VERIFIED = "checksum_verified"
EVENTS = (
    OPERATION_START, OPERATION_COMPLETE, ERROR, WARNING, VALIDATION, PROFILE_DETECTED,
    FILE_PROCESSED, CHECKSUM_VERIFIED,
)


def _details(**fields: Column) -> Column:
    """JSON object with every key present, nulls included."""
    return F.to_json(
        F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}
    )


def start_details(mode: Column, profile: Column, source: Column, destination: Column) -> Column:
    return _details(mode=mode, profile=profile, source=source, destination=destination)


def complete_details(mode: Column, profile: Column, source: Column, destination: Column,
                     processed: Column, skipped: Column, errors: Column,
                     checksums_verified: Column, elapsed_ms: Column) -> Column:
    """Counts carry the processed and failed numbers under both of their names."""
    counts = F.struct(
        processed.alias("processed"), processed.alias("added"), skipped.alias("skipped"),
        errors.alias("failed"), errors.alias("errors"),
    )
    return _details(
        mode=mode, profile=profile, source=source, destination=destination, counts=counts,
        checksumsVerified=checksums_verified, elapsedMs=elapsed_ms,
    )


def error_details(mode: Column, profile: Column, source: Column, message: Column,
                  error_type: Column, file_path: Column) -> Column:
    return _details(
        mode=mode, profile=profile, source=source, errorMessage=F.coalesce(message, F.lit("")),
        errorType=error_type, filePath=file_path,
    )


def warning_details(message: Column, context: Column | None = None) -> Column:
    """``context`` is a map or struct; none is an empty object."""
    empty = F.create_map().cast("map<string,string>")
    return _details(message=message, context=empty if context is None else context)


def detected_details(profile: Column, attempted: Column, confidence: Column | None = None) -> Column:
    return _details(
        detectedProfile=profile, attemptedProfiles=attempted,
        confidence=F.lit("high") if confidence is None else confidence,
    )


def processed_details(path: Column, encoding: Column, eol: Column, is_binary: Column,
                      size: Column) -> Column:
    return _details(
        filePath=path, encoding=encoding, eolStyle=eol, isBinary=is_binary, sizeBytes=size
    )


def checksum_details(path: Column, verified: Column, expected: Column, actual: Column) -> Column:
    return _details(filePath=path, verified=verified, expected=expected, actual=actual)


def log_events(df: DataFrame, session: Column, event: Column | str, details: Column,
               timestamp: Column | None = None) -> DataFrame:
    """Rows of the log. Any event name is allowed."""
    return df.select(
        session.cast("string").alias("sessionId"),
        (F.current_timestamp() if timestamp is None else timestamp).alias("timestamp"),
        (F.lit(event) if isinstance(event, str) else event).alias("event"),
        details.alias("details"),
    )


def field(path: str, as_type: str = "string") -> Column:
    """A value inside the details, by JSON path."""
    return F.get_json_object("details", path).cast(as_type)


def event_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("sessionId", "event").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
    )


def session_summary(log: DataFrame) -> DataFrame:
    """``sessionId, startTime, endTime, totalEvents, eventCounts``; the map holds one value per
    distinct event name of the session."""
    return event_counts(log).groupBy("sessionId").agg(
        F.min("first").alias("startTime"), F.max("last").alias("endTime"),
        F.sum("n").alias("totalEvents"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("event", "n")))).alias("eventCounts"),
    )


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.LOG).json(path)


def stream_event_counts(log: DataFrame) -> DataFrame:
    """Running counts of all time. The state holds one row per session and event name, for good."""
    return event_counts(log)


def run_available(stream: DataFrame, path: str, checkpoint: str,
                  mode: str = "complete") -> StreamingQuery:
    """Drain what is there.

    ``complete`` replaces the table of all counts with every batch. ``update`` writes only the
    counts a batch has changed, into a folder of that batch, so that the work follows the new
    events and a repeated batch replaces its own folder; :func:`latest_counts` reads those.
    """

    def publish(batch: DataFrame, epoch: int) -> None:
        target = path if mode == "complete" else f"{path}/batch={epoch}"
        batch.write.mode("overwrite").parquet(target)

    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(publish).start()
    )


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of every session and event name out of update batches."""
    newest = F.max(F.struct("batch", "n", "first", "last")).alias("c")
    return spark.read.parquet(path).groupBy("sessionId", "event").agg(newest).select(
        "sessionId", "event", "c.n", "c.first", "c.last"
    )


_BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Bundle files as they arrive, one row each, named and decoded as by ``read_bundles_text``: by
    the path below ``path``, with undecodable bytes dropped."""
    files = spark.readStream.format("binaryFile").schema(_BINARY_FILE).option("recursiveFileLookup", True).load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    below = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    return files.select(below.alias("bundle_id"), decode_ignore(F.col("content")).alias("text"))


def validate_stream(bundles: DataFrame, out: str, checkpoint: str,
                    available_now: bool = True) -> StreamingQuery:
    """Reports of arriving bundles, appended. Validation is row-local, so no state is kept; each
    micro-batch writes its own folder and a repeated batch replaces it."""
    from sheaf.plans.parsing import validate_bundles

    def publish(batch: DataFrame, epoch: int) -> None:
        validate_bundles(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    writer = bundles.writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def parse_stream(bundles: DataFrame) -> DataFrame:
    """Entries of arriving bundles as a stream of their own: parsing needs no state."""
    from sheaf.plans.parsing import parse_bundles

    return parse_bundles(bundles)
