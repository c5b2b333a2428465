import json

from pyspark.sql import functions as F

from sheaf.plans.parsing import validate_bundles
from sheaf.sources.sinks import append_log, read_log
from sheaf.streaming import events as E


def test_builders(spark):
    row = spark.range(1).select(
        E.complete_details(F.lit("bundle"), F.lit("md_fence"), F.lit("s"), F.lit("d"), F.lit(3), F.lit(1), F.lit(2), F.lit(True), F.lit(9)).alias("done"),
        E.error_details(F.lit("m"), F.lit(None).cast("string"), F.lit("s"), F.lit(None).cast("string"), F.lit("T"), F.lit(None).cast("string")).alias("error"),
        E.warning_details(F.lit("w"), F.create_map(F.lit("k"), F.lit("v"))).alias("warning"),
    ).first()
    done = json.loads(row.done)
    assert done["counts"] == {"processed": 3, "added": 3, "skipped": 1, "failed": 2, "errors": 2}
    assert done["checksumsVerified"] is True and done["elapsedMs"] == 9
    assert json.loads(row.error) == {"mode": "m", "profile": None, "source": "s", "errorMessage": "", "errorType": "T", "filePath": None}
    assert json.loads(row.warning) == {"message": "w", "context": {"k": "v"}}
    assert len(E.EVENTS) == 8


def events(spark, start, n):
    base = spark.range(start, start + n)
    return E.log_events(
        base, F.concat(F.lit("s"), F.col("id") % 3), F.when(F.col("id") % 2 == 0, F.lit("error")).otherwise("custom"),
        E.warning_details(F.col("id").cast("string")), F.timestamp_seconds(F.col("id")),
    )


def test_stream_equals_batch(spark, tmp_path):
    log, out, state = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "state")
    for start, n in ((0, 20), (20, 7), (27, 13)):
        append_log(events(spark, start, n), log)
        E.run_available(E.stream_event_counts(E.stream_log(spark, log)), out, state).awaitTermination()
        want = E.event_counts(read_log(spark, log)).collect()
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want))
        E.run_available(E.stream_event_counts(E.stream_log(spark, log)), out + "_u", state + "_u", "update").awaitTermination()
        assert sorted(map(tuple, E.latest_counts(spark, out + "_u").collect())) == sorted(map(tuple, want))
    summary = {r.sessionId: r for r in E.session_summary(read_log(spark, log)).collect()}
    assert summary["s0"].totalEvents == 14 and summary["s0"].eventCounts == {"error": 7, "custom": 7}
    assert E.stream_event_counts(E.stream_log(spark, log)).isStreaming


def test_bundles_as_they_arrive(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    texts = {"a.txt": "# FILE: x\n1\n", "b.txt": "nothing", "c.txt": "<!-- FILE: x; a=1 -->\n```\n1\n```"}
    for name, text in texts.items():
        (inbox / name).write_text(text)
    out = str(tmp_path / "out")
    E.validate_stream(E.stream_bundles(spark, str(inbox)), out, str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(out).select("bundle_id", "valid", "profile", "file_count").collect()
    want = validate_bundles(spark.createDataFrame(list(texts.items()), "bundle_id string, text string")).select(
        "bundle_id", "valid", "profile", "file_count").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    query = E.parse_stream(E.stream_bundles(spark, str(inbox))).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "parse")).start()
    query.awaitTermination()
    assert sorted(r.content for r in spark.table("arrived").collect()) == ["1", "1\n"]
