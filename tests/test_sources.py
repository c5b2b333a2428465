import json

from pyspark.sql import functions as F

from sheaf import schemas
from sheaf.functions.globs import DEFAULT_DENY
from sheaf.operators.manifest import create_manifest, number_files, oversized_files
from sheaf.operators.ordinal import ranged_ordinal, with_ordinal
from sheaf.plans.formatting import format_blocks, format_bundles
from sheaf.plans.parsing import parse_bundles, parse_parts, validate_bundles
from sheaf.sources import sinks
from sheaf.sources.blocks import read_bundles_text, read_slices
from sheaf.sources.filetree import discover_files, in_discovery_order, list_files, python_files, read_contents

import pytest


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    files = {
        "src/main.py": b"x = 1\r\n", "src/__init__.py": b"", ".hidden": b"h", "_u.py": b"u", ".git/config": b"g",
        "a/x.txt": b"1", "a-b/x.txt": b"2", "assets/logo.png": b"\x89PNG", "logs/app.log": b"l", "deep/a/b/c/d.PY": b"d",
    }
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root, files


def test_listing_is_complete(spark, tree):
    root, files = tree
    rows = list_files(spark, str(root)).collect()
    assert {r.abs_path.removeprefix(f"{root}/"): r.length for r in rows} == {n: len(d) for n, d in files.items()}
    assert [r.abs_path for r in list_files(spark, str(root / ".hidden")).collect()] == [str(root / ".hidden")]
    assert {r.path for r in python_files(discover_files(spark, str(root))).collect()} == {"src/main.py", "src/__init__.py", "_u.py", "deep/a/b/c/d.PY"}


def test_missing_source(spark, tmp_path):
    with pytest.raises(Exception, match="does not exist"):
        list_files(spark, str(tmp_path / "none")).collect()


def test_discovery(spark, tree):
    root, files = tree
    found = [r.path for r in in_discovery_order(discover_files(spark, str(root))).collect()]
    assert found == [".hidden", "_u.py", "a/x.txt", "a-b/x.txt", "assets/logo.png", "deep/a/b/c/d.PY", "src/__init__.py", "src/main.py"]
    two = discover_files(spark, [str(root / "src"), str(root / "_u.py")], base=str(root), deny=DEFAULT_DENY)
    assert [(r.source_ord, r.path) for r in in_discovery_order(two).collect()] == [(0, "src/__init__.py"), (0, "src/main.py"), (1, "_u.py")]
    assert discover_files(spark, str(root), base=str(root / "src")).count() == 2


def test_tree_to_bundle_and_back(spark, tree, tmp_path):
    root, files = tree
    listing = number_files(discover_files(spark, str(root), deny=[]))
    assert oversized_files(listing, 0.000005).count() == 1
    entries = create_manifest(read_contents(listing))
    rows = {r.path: r for r in entries.collect()}
    assert rows["assets/logo.png"].is_binary and rows["src/main.py"].eol_style == "CRLF" and len(rows) == len(files)
    bundles = format_bundles(entries, "md_fence")
    sinks.write_bundles(spark, bundles, str(tmp_path / "out"))
    text = read_bundles_text(spark, str(tmp_path / "out"))
    assert text.first().bundle_id == "bundle.txt" and text.first().text == bundles.first().text
    back = {r.path: r.content for r in parse_bundles(text).collect()}
    assert back == {p: r.content for p, r in rows.items()}


@pytest.mark.parametrize("profile", ["plain_marker", "md_fence"])
@pytest.mark.parametrize("step", [7, 100, 1000, 10**9])
def test_blocks_of_one_file_over_many_tasks(spark, tmp_path, profile, step):
    rows = [("b", i, f"d{i}/f.py", f"line {i}\n" * (i % 5), "utf-8", False, "LF") for i in range(40)]
    rows.append(("b", 40, "d3/f.py" if profile == "plain_marker" else "z", "again\n", "utf-8", False, "LF"))
    entries = spark.createDataFrame(rows, "bundle_id string, entry_idx bigint, path string, content string, encoding string, is_binary boolean, eol_style string")
    text = "junk\n" + format_bundles(entries, profile).first().text
    text = text.replace("# FILE: d9/", "\t#file :d9/").replace("<!-- FILE: d9/", " <!--file: d9/").replace("line 7\n", "line 7\r\n")
    (tmp_path / "one.txt").write_bytes(text.encode())
    got = parse_parts(read_slices(spark, str(tmp_path / "one.txt"), step), profile).orderBy("entry_idx").collect()
    want = parse_bundles(spark.createDataFrame([("b", text)], "bundle_id string, text string"), profile).orderBy("entry_idx").collect()
    assert [(r.path, r.content) for r in got] == [(r.path, r.content) for r in want] and len(want) >= 40


def test_carriage_return_bundle_is_not_lost(spark, tmp_path):
    (tmp_path / "cr.txt").write_bytes(b"# FILE: a\rx\r# FILE: b\ry\r")
    got = parse_parts(read_slices(spark, str(tmp_path), 5), "plain_marker").orderBy("entry_idx").collect()
    assert [(r.path, r.content) for r in got] == [("a", "x\r"), ("b", "y\r")]


def test_undecodable_bundle_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"# FILE: a\n\xffok\r\n")
    (tmp_path / "_empty").touch()
    got = {r.bundle_id: r.text for r in read_bundles_text(spark, str(tmp_path), newline_text=True).collect()}
    assert got == {"x.txt": "# FILE: a\nok\n", "_empty": ""}
    assert read_bundles_text(spark, str(tmp_path / "x.txt")).first().bundle_id == "x.txt"


def test_blocks_as_text_folders(spark, tmp_path):
    rows = [(f"b{i % 2}", i, f"f{i:02d}", f"c{i}\n", "utf-8", False, "LF") for i in range(30)]
    entries = spark.createDataFrame(rows, "bundle_id string, entry_idx bigint, path string, content string, encoding string, is_binary boolean, eol_style string")
    for profile, separator in (("plain_marker", ""), ("md_fence", "\n\n")):
        root = tmp_path / profile
        sinks.write_blocks_text(spark, format_blocks(entries, profile), str(root), separator)
        want = {r.bundle_id: r.text for r in format_bundles(entries, profile).collect()}
        for b, text in want.items():
            parts = sorted((root / b).glob("part-*"))
            assert "".join(p.read_text() for p in parts) == text
        parts = format_bundles(entries, profile, max_bytes=300)
        sinks.write_bundles(spark, parts, str(tmp_path / f"{profile}-parts"), "", separator)
        for b, text in want.items():
            files = sorted((tmp_path / f"{profile}-parts").glob(f"{b}.*"))
            assert len(files) > 1 and "".join(p.read_text() for p in files) == text


def _payloads(spark, rows):
    return spark.createDataFrame([(*r, bytearray(b"x")) for r in rows], "bundle_id string, entry_idx bigint, target string, status string, payload binary")


def test_extraction_keeps_bundles_apart(spark, tmp_path):
    actions = _payloads(spark, [("a", 0, "a.txt", "processed"), ("../b", 0, "a.txt", "processed"), ("a", 1, "no", "skipped")])
    sinks.write_actions(spark, actions, str(tmp_path / "out"))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["out/%..%2Fb/a.txt", "out/a/a.txt"]
    with pytest.raises(Exception, match="Several bundles"):
        sinks.write_actions(spark, actions, str(tmp_path / "flat"), flat=True)
    assert not list((tmp_path / "flat").rglob("*"))


@pytest.mark.parametrize("target", ["../esc.txt", "/abs.txt", "a/../../b"])
def test_nothing_is_written_outside_or_by_a_failed_job(spark, tmp_path, target):
    files = spark.createDataFrame([("fine.txt", bytearray(b"1")), (target, bytearray(b"2"))], "target string, payload binary")
    with pytest.raises(Exception, match="outside"):
        sinks.write_files(spark, files.repartition(2), str(tmp_path / "out"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_log_loses_no_event(spark, tmp_path):
    rows = [(None, None, None, None), ("s", None, "e", None), ("s", None, "e", "not json"), ("s", None, "e", '{"a":\n1}')]
    log = spark.createDataFrame(rows, "sessionId string, timestamp timestamp, event string, details string")
    sinks.append_log(log, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == 4 and sorted(str(x["details"]) for x in lines) == ["None", "None", "not json", "{'a': 1}"]


def test_ordinals_agree(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 50 AS STRING) END AS k", "id * 7919 % 5003 AS v")
    windowed = with_ordinal(df, ["k"], [F.col("v")], "n")
    ranged = ranged_ordinal(df, ["k"], [F.col("v")], "n")
    assert sorted(map(tuple, windowed.collect())) == sorted(map(tuple, ranged.collect()))
    hot = with_ordinal(df, ["k"], [F.col("v")], "n", hot_group_rows=100)
    assert sorted(map(tuple, hot.collect())) == sorted(map(tuple, windowed.collect()))


def test_log_round_trip(spark, tmp_path):
    stored = tmp_path / "in"
    stored.mkdir()
    (stored / "a.json").write_text(
        '{"timestamp": "2024-03-05T06:07:08.123456+00:00", "sessionId": "q1", "event": "started", "details": {"status": "fine"}}\n'
        '{"sessionId": "b9", "timestamp": "2024-03-05T06:07:09.000001+00:00", "event": "a \\"b\\"", "details": {"message": "m", "context": {}}}\n')
    log = sinks.read_log(spark, str(stored))
    sinks.append_log(log, str(tmp_path / "out"))
    sinks.append_log(log, str(tmp_path / "out"))
    again = sinks.read_log(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect())) == sorted([*map(tuple, log.collect())] * 2)
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    first = [x for x in lines if x["sessionId"] == "q1"]
    assert len(first) == 2 and first[0]["details"] == {"status": "fine"}
    assert first[0]["timestamp"] == "2024-03-05T06:07:08.123456+00:00"


def test_changelog_csv(spark, tmp_path):
    row = ["", "path", "o", "n", "module", "added", None, None, 3, 1, None, "Expr", None, 'say "hi", then']
    kinds = ["int" if c.startswith(("line", "pos")) else "string" for c in schemas.CHANGE_COLUMNS]
    df = spark.createDataFrame([tuple(row)], ", ".join(f"{c} {k}" for c, k in zip(schemas.CHANGE_COLUMNS, kinds)))
    sinks.write_changelog(df.coalesce(1), str(tmp_path / "csv"))
    lines = next((tmp_path / "csv").glob("part-*.csv")).read_text().splitlines()
    assert lines[0].split(",") == list(schemas.CHANGE_COLUMNS)
    assert lines[1] == ',path,o,n,module,added,,,3,1,,Expr,,"say ""hi"", then"'


def test_given_positions_do_not_hide_duplicate_paths(spark):
    rows = [("b", i, f"f{i % 3}.txt", 1, b"x") for i in range(4)]
    files = spark.createDataFrame(rows, "bundle_id string, entry_idx long, path string, length long, content binary")
    with pytest.raises(Exception, match="Duplicate file path in bundle 'b': f0.txt"):
        create_manifest(files).collect()
    assert create_manifest(files, duplicates="keep").count() == 4
    assert create_manifest(files.filter("entry_idx < 3")).count() == 3
    assert create_manifest(files.limit(0)).count() == 0


def test_numbered_files_are_not_counted_again(spark):
    files = spark.createDataFrame([("b", "f.txt", 1, b"x")], "bundle_id string, path string, length long, content binary")
    placed = files.join(number_files(files.select("bundle_id", "path")), ["bundle_id", "path"])
    assert placed.schema["entry_idx"].metadata == {"paths_differ": True}
    plan = create_manifest(placed)._jdf.queryExecution().analyzed().toString()
    assert "scalar-subquery" not in plan
    with pytest.raises(Exception, match="Duplicate file path"):
        number_files(files.union(files).select("bundle_id", "path")).collect()


def test_numbering_and_its_check_share_one_shuffle(spark):
    files = spark.range(50).selectExpr("concat('b', id % 3) AS bundle_id", "concat('d/', id) AS path")
    plan = number_files(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_preview_counts_the_separators_of_parts(spark):
    from sheaf.operators.manifest import preview
    from sheaf.plans.formatting import format_bundles

    rows = [(f"b{b}", i, f"f{i}.txt", 40, bytes([97 + i]) * 40) for b in range(2) for i in range(9)]
    files = spark.createDataFrame(rows, "bundle_id string, entry_idx long, path string, length long, content binary")
    entries = create_manifest(files)
    for profile in ("plain_marker", "md_fence"):
        whole, parts = (preview(entries, format_bundles(entries, profile, max_bytes=n)) for n in (1 << 20, 300))
        assert format_bundles(entries, profile, max_bytes=300).count() > 2
        assert sorted(whole.collect()) == sorted(parts.collect())
