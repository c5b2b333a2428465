import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators.extract import plan_extraction
from sheaf.sources import filetree, sinks
from sheaf.streaming import extraction, sessions

LOG = "sessionId string, timestamp timestamp, event string"


def deliver(spark, path, rows):
    frame = spark.createDataFrame(rows, "sessionId string, at double, event string")
    frame.select("sessionId", F.timestamp_seconds("at").alias("timestamp"), "event").coalesce(1).write.mode("append").parquet(path)


def by_hand(rows, gap, until):
    """Sessions of whole seconds that are over at a time."""
    out = []
    for name in {r[0] for r in rows}:
        runs = []
        for _, at, event in sorted((r for r in rows if r[0] == name), key=lambda r: r[1]):
            if not runs or at - runs[-1][-1][0] > gap:
                runs.append([])
            runs[-1].append((at, event))
        for run in runs:
            if run[-1][0] + gap <= until:
                counts = {e: sum(x == e for _, x in run) for _, e in run}
                out.append((name, run[0][0], run[-1][0], len(run), counts))
    return sorted(out, key=lambda r: r[:2])


def test_sessions_over_many_deliveries(spark, tmp_path):
    """Disorder within the delay joins and lengthens sessions that earlier batches have opened."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    pick = random.Random(5)
    rows = [(f"s{pick.randrange(4)}", 1000.0 + t, pick.choice("abc")) for t in pick.sample(range(3000), 300)]
    rows.sort(key=lambda r: r[1] + pick.uniform(0, 90))
    late = 0
    for i in range(0, 300, 100):
        deliver(spark, source, rows[i:i + 100])
        query = sessions.run_sessions(
            sessions.ended_sessions(spark.readStream.schema(LOG).parquet(source), 40, "100 seconds"), out, state)
        query.awaitTermination()
        late += sessions.late_rows(query)
    got = sorted(((r.sessionId, r.a, r.b, r.totalEvents, r.eventCounts) for r in spark.read.parquet(out).select(
        "*", F.unix_seconds("startTime").alias("a"), F.unix_seconds("endTime").alias("b")).collect()), key=lambda r: r[:2])
    assert late == 0 and got == by_hand(rows, 40, max(r[1] for r in rows) - 100) and len(got) > 40
    deliver(spark, source, [("s0", 1001.0, "a"), ("s9", 9000.0, None)])
    query = sessions.run_sessions(
        sessions.ended_sessions(spark.readStream.schema(LOG).parquet(source), 40, "100 seconds"), out, state)
    query.awaitTermination()
    assert sessions.late_rows(query) == 1
    assert spark.read.parquet(out).count() == len(by_hand(rows, 40, 8900))


def test_claims_of_earlier_deliveries_stay(spark, tmp_path):
    schema = "bundle_id string, entry_idx bigint, path string, content string, encoding string, is_binary boolean, eol_style string"
    rows = [("b", i, p, "x", "utf-8", False, "LF") for i, p in enumerate(["a.t", "a_1.t", "a.t", "b.t", "a.t", "a_1.t", "b.t", "../c", "a_1_1.t"])]
    existing = spark.createDataFrame([("b", "b.t"), ("b", "a_2.t"), ("other", "a.t")], "bundle_id string, target string")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i in range(0, 9, 3):
        spark.createDataFrame(rows[i:i + 3], schema).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(schema).parquet(source)
        extraction.extract_stream(arriving, existing, out, state, "rename").awaitTermination()
    want = plan_extraction(spark.createDataFrame(rows, schema), existing, "rename")
    columns = ["entry_idx", "target", "status", "renamed_from", "error", "payload"]
    got = extraction.planned_actions(spark, out)
    assert got.select(columns).orderBy("entry_idx").collect() == want.select(columns).orderBy("entry_idx").collect()


def test_files_by_head_and_digest(spark, tmp_path, monkeypatch):
    root = tmp_path / "files"
    root.mkdir()
    data = {"empty": b"", "text": b"x\n" * 5000, "nul": b"a\0", "late": b"a" * 9000 + b"\0", "big": os.urandom(3 << 20)}
    sinks.write_files(spark, spark.createDataFrame([(n, bytearray(d)) for n, d in data.items()], "target string, payload binary"), str(root))
    os.symlink(root / "nowhere", root / "broken")
    listing = filetree.discover_files(spark, str(root), deny=[])
    assert {r.path: r.length for r in listing.collect()} == {n: len(d) for n, d in data.items()}
    assert [r.abs_path for r in filetree.unreadable_files(spark, str(root)).collect()] == [str(root / "broken")]
    assert all(r.error for r in filetree.unreadable_files(spark, str(root)).collect())
    heads = {r.path: bytes(r.head) for r in filetree.read_heads(listing).collect()}
    assert heads == {n: d[:8192] for n, d in data.items()}
    sniffed = {r.path: r.is_binary for r in filetree.sniff_files(listing).collect()}
    assert sniffed == {"empty": False, "text": False, "nul": True, "late": False, "big": True}
    gone = listing.unionByName(spark.createDataFrame([("bundle", 0, "gone", str(root / "gone"), 1)], listing.schema))
    digests = {r.path: r for r in filetree.digest_files(gone).collect()}
    assert digests.pop("gone").sha256 is None
    assert {n: (r.sha256, r.n_read) for n, r in digests.items()} == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in data.items()}


def test_failed_write_leaves_nothing(spark, tmp_path):
    root = tmp_path / "files"
    rows = spark.createDataFrame([("ok", bytearray(b"1")), ("../out", bytearray(b"2"))], "target string, payload binary")
    with pytest.raises(Exception, match="outside of the output folder"):
        sinks.write_files(spark, rows, str(root))
    assert filetree.list_files(spark, str(tmp_path)).count() == 0
