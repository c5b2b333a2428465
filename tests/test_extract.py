import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sheaf.operators import extract as X
from sheaf.sources.sinks import write_actions

ENTRY = "bundle_id string, entry_idx bigint, path string, content string, encoding string, is_binary boolean, eol_style string"
EXISTING = "bundle_id string, target string"


def entries(spark, items, bundle="b"):
    rows = [(bundle, i, p, c, e, b, "LF") for i, (p, c, e, b) in enumerate(items)]
    return spark.createDataFrame(rows, ENTRY)


def text(path, content="x"):
    return (path, content, "utf-8", False)


def existing(spark, *targets, bundle="b"):
    return spark.createDataFrame([(bundle, t) for t in targets], EXISTING)


def one_by_one(paths, there):
    taken, out = set(there), []
    for p in paths:
        final, n = p, 0
        stem, dot, suffix = p.rpartition(".")
        while final in taken:
            n += 1
            final = f"{stem}_{n}{dot}{suffix}"
        taken.add(final)
        out.append(final)
    return out


def test_rename_brute_force(spark):
    """Each bundle is its own claim list over names that collide in chains."""
    rng = random.Random(11)
    names = ["a.t", "a_1.t", "a_2.t", "a_1_1.t", "a_10.t", "b.t", "b_01.t", "d/a.t", "a_1.u", "c_0.t", "c_0_1.t"]
    rows, files, want = [], [], {}
    for k in range(250):
        paths = [rng.choice(names) for _ in range(rng.randint(1, 9))]
        there = [n for n in names if rng.random() < 0.25]
        # Distinct spellings of one target, as a manifest's paths are distinct.
        spelled = [("./" * i) + p for i, p in enumerate(paths)]
        rows += [(str(k), i, p, "x", "utf-8", False, "LF") for i, p in enumerate(spelled)]
        files += [(str(k), t) for t in there]
        want[str(k)] = one_by_one(paths, there)
    plan = X.plan_extraction(spark.createDataFrame(rows, ENTRY), spark.createDataFrame(files, EXISTING), "rename")
    got = {}
    for r in plan.orderBy("bundle_id", "entry_idx").collect():
        got.setdefault(r.bundle_id, []).append(r.target)
    assert got == want


def test_lowest_free_number(spark):
    plan = X.plan_extraction(entries(spark, [text("file.txt")]), existing(spark, "file.txt", "file_1.txt"), "rename")
    row = plan.first()
    assert (row.target, row.renamed_from, row.status) == ("file_2.txt", "file.txt", "processed")


def test_partial_failure(spark):
    e = entries(spark, [text("../../bad.txt"), text("good.txt"), ("x.bin", "YQ", "base64", True), ("y.txt", "y", "no-set", False)])
    plan = X.plan_extraction(e, existing(spark, "none"), "skip", add_headers=False)
    stats = X.extraction_stats(plan).first()
    assert (stats.processed, stats.skipped, stats.errors) == (1, 0, 3)
    errors = [r.error for r in plan.orderBy("entry_idx").collect()]
    assert "escapes" in errors[0] and errors[1] is None and "decode" in errors[2] and "unknown encoding: no-set" in errors[3]


def test_broken_entry_holds_no_place(spark):
    e = entries(spark, [("a.bin", "YQ", "base64", True), ("./a.bin", "YQ==", "base64", True), ("/a.bin", "YQ", "base64", True)])
    rows = X.plan_extraction(e, existing(spark, "none"), "skip").orderBy("entry_idx").collect()
    assert [r.status for r in rows] == ["error", "processed", "skipped"]
    rows = X.plan_extraction(e, existing(spark, "none"), "rename").orderBy("entry_idx").collect()
    assert [(r.status, r.target) for r in rows] == [("error", "a.bin"), ("processed", "a.bin"), ("error", "a.bin")]


def test_prompt_stops_before_writing(spark, tmp_path):
    e = entries(spark, [text("a.txt"), text("b.txt")])
    with pytest.raises(PySparkException, match="already exists"):
        write_actions(spark, X.plan_extraction(e, existing(spark, "b.txt"), "nonsense"), str(tmp_path))
    assert list(tmp_path.iterdir()) == []
    assert [r.target for r in X.conflicts(e, existing(spark, "b.txt")).collect()] == ["b.txt"]


def test_absolute_paths(spark):
    e = entries(spark, [text("/etc/x")])
    assert X.plan_extraction(e, existing(spark, "none"), "skip").first().target == "etc/x"
    strict = X.plan_extraction(e, existing(spark, "none"), "skip", path_mode="strict").first()
    assert strict.status == "error" and "Absolute" in strict.error


def test_files_are_written(spark, tmp_path):
    e = entries(spark, [text("a/b.txt", "x\r\n"), ("c.bin", "AAE=", "base64", True), text("./a/b.txt", "later"), ("d.txt", "é", "utf-8-bom", False)])
    write_actions(spark, X.plan_extraction(e, existing(spark, "none"), "overwrite", add_headers=False), str(tmp_path), flat=True)
    assert (tmp_path / "a/b.txt").read_bytes() == b"later"
    assert (tmp_path / "c.bin").read_bytes() == b"\x00\x01"
    assert (tmp_path / "d.txt").read_bytes() == b"\xef\xbb\xbf\xc3\xa9"
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["b.txt", "c.bin", "d.txt"]


def test_headers(spark):
    row = X.plan_extraction(entries(spark, [text("s\\a.py", "x\n")]), existing(spark, "none"), "skip", project="p").first()
    lines = bytes(row.payload).decode().split("\n")
    assert len(lines) == 14 and lines[1] == "# SOURCEFILE: a.py" and lines[2] == "# RELPATH: s/a.py"
    assert lines[3] == "# PROJECT: p" and lines[-2:] == ["x", ""]


def test_names_without_number_are_no_numbered_forms(spark):
    """A name that is the same for all files is worked out before any file is left out."""
    rows = entries(spark, [text("a.md"), text("./a.md"), text("/a.md")])
    there = spark.range(1).select(F.lit("b").alias("bundle_id"), F.lit("a.md").alias("target"))
    plan = X.plan_extraction(rows, there, "rename")
    assert [r.target for r in plan.orderBy("entry_idx").collect()] == ["a_1.md", "a_2.md", "a_3.md"]
