"""Bundles in parts, running sums, free numbers and mappings against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators.diff import map_files
from sheaf.operators.extract import rename_targets
from sheaf.operators.ordinal import running_sums
from sheaf.plans import formatting, parsing
from sheaf.plans.formatting import assemble, format_bundles
from sheaf.plans.parsing import _apart, parse_bundles, parse_errors, parse_parts, validate_bundles
from sheaf.session import checkpoint, stored
from sheaf.sources.blocks import read_slices
from workload import bundle_queries

ENTRY = "bundle_id string, entry_idx bigint, path string, content string, encoding string, is_binary boolean, eol_style string"


def made(seed: int, profile: str) -> str:
    """Lines of every kind in random order."""
    rng = random.Random(seed)
    kinds = {
        "md_fence": ["<!-- FILE: {}; encoding=utf-8; eol=LF -->\n", " <!--file:{};mode=binary-->\r\n", "```\n", "```\n", "``` \n", "```py\n", "text\n", "\n", "é\r\n", "a\x0bb\n"],
        "plain_marker": ["# FILE: {}\n", "#file :{}  \n", "# META: eol=CRLF; trailing=false\n", "# META: encoding=latin-1\n", "# ============\n", "text\n", "\n", "x\ry\n"],
    }[profile]
    lines = [rng.choice(kinds).format(f"p{rng.randrange(12)}" if rng.random() < 0.3 else f"q{i}") for i in range(rng.randrange(1, 90))]
    return "".join(lines) + rng.choice(["", "open end", "```"])


@pytest.mark.parametrize("profile", ["plain_marker", "md_fence"])
def test_parts_cut_at_any_line(spark, profile):
    rng, whole, parts = random.Random(9), [], []
    for b in range(120):
        text = made(b, profile)
        lines, at, no = text.split("\n"), 0, 0
        lines = [line + "\n" for line in lines[:-1]] + [lines[-1]] * bool(lines[-1])
        whole.append((f"b{b}", text))
        while at < len(lines):
            n = rng.choice([1, 2, 5, 40])
            parts.append((f"b{b}", no, "".join(lines[at:at + n]), True))
            at, no = at + n, no + rng.choice([1, 3])
    w = spark.createDataFrame(whole, "bundle_id string, text string")
    p = spark.createDataFrame(parts, "bundle_id string, part_no bigint, text string, in_parts boolean")
    shown = lambda df: sorted((r.bundle_id, r.path, r.content, r.encoding, r.is_binary, r.eol_style) for r in df.collect())
    assert shown(parse_parts(p, profile)) == shown(parse_bundles(w, profile))
    report = lambda df: sorted(map(tuple, validate_bundles(df, profile).collect()))
    assert report(p) == report(w) and len(report(p)) == 120
    errors = lambda df: sorted(map(tuple, parse_errors(df, profile).collect()))
    assert errors(p) == errors(w) and 0 < len(errors(p))


@pytest.mark.parametrize("profile", ["plain_marker", "md_fence"])
def test_rows_of_one_part(spark, profile):
    """Part numbers that repeat, with the same text and with others: blocks of one number keep apart."""
    head = "# FILE: {}\n" if profile == "plain_marker" else "<!-- FILE: {}; eol=LF -->\n```\n"
    end = "" if profile == "plain_marker" else "```\n"
    block = lambda path, body: head.format(path) + body + "\n" + end
    rows = [("a", 0, block("p", "1")), ("a", 0, block("q", "2")), ("a", 1, block("r", "3")), ("a", 1, block("s", "4")[:len(block("s", "4")) - len(end)]),
            ("a", 2, "more\n" + end), ("b", 0, block("p", "1")), ("b", 0, block("p", "1")), ("c", 0, block("p", "1")), ("c", 3, "tail\n"), ("c", 3, "tail\n")]
    joined = [(b, "".join(t for k, _, t in sorted(rows) if k == b)) for b in "abc"]
    p = spark.createDataFrame([(*r, True) for r in rows], "bundle_id string, part_no bigint, text string, in_parts boolean")
    w = spark.createDataFrame(joined, "bundle_id string, text string")
    shown = lambda df: sorted((r.bundle_id, r.path, r.content) for r in df.collect())
    assert shown(parse_parts(p, profile)) == shown(parse_bundles(w, profile))
    assert len(shown(parse_parts(p, profile))) == (6 if profile == "plain_marker" else 5)
    report = lambda df: sorted(map(tuple, validate_bundles(df, profile).collect()))
    assert report(p) == report(w)


@pytest.mark.parametrize("split", [200, 5000, 10**8])
def test_slices_of_files_in_splits(spark, tmp_path, split):
    texts = {"one.txt": made(1, "md_fence") * 20, "in/two +%20.txt": "é\n" * 999 + "open", "empty": "", "in/nl": "\n\n", "long": "x" * 3000 + "\ny\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, split)
    try:
        rows = read_slices(spark, str(tmp_path), 300).collect()
        one = read_slices(spark, f"file://{tmp_path}/one.txt").collect()
    finally:
        spark.conf.set(key, before)
    got = {}
    for r in sorted(rows, key=lambda r: (r.bundle_id, r.part_no)):
        got[r.bundle_id] = got.get(r.bundle_id, "") + r.text
    assert got == {name: text for name, text in texts.items() if text}
    assert len({(r.bundle_id, r.part_no) for r in rows}) == len(rows) > 10
    assert {r.bundle_id for r in one} == {"one.txt"}


def test_parts_by_running_bytes(spark):
    rng = random.Random(4)
    rows = [(b, i * 3, "x" * rng.choice([1, 10, 30, 60, 90, 300])) for b in ("a", "b", "c") for i in range(200)] + [("small", 0, "s")]
    df = spark.createDataFrame(rows, "bundle_id string, entry_idx bigint, block string")
    for limit in (1, 100, 101, 1000, 10**6):
        parts = sorted(assemble(df, "--", limit).collect(), key=lambda r: (r.bundle_id, r.part_no))
        for b in ("a", "b", "c", "small"):
            own = [r for r in parts if r.bundle_id == b]
            assert own[0].part_no == 0 and len({r.part_no for r in own}) == len(own)
            assert "--".join(r.text for r in own) == "--".join(t for k, _, t in rows if k == b)
            assert all(len(r.text) <= limit or "--" not in r.text for r in own)
            assert not (b == "small" and limit > 3) or not own[0].in_parts


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(k, p, rng.randrange(5)) for k in "ab" for p in rng.sample(range(-50, 500), 200)]
    df = spark.createDataFrame(rows, "k string, p bigint, v bigint")
    for chunk in (1, 7, 10**6):
        for r in running_sums(df, ["k"], "p", ["v"], chunk).collect():
            assert r.v_before == sum(v for k, p, v in rows if k == r.k and p < r.p)


def test_free_numbers(spark):
    """Latecomers of names with numbered forms on disk, one of them far more frequent than the rest."""
    rng = random.Random(3)
    disk = [("b", f"a_{n}.t") for n in {rng.randrange(1, 400) for _ in range(150)}] + [("b", "a.t"), ("b", "a_007.t"), ("b", "a_1_2.t"), ("b", "c_2"), ("b", "a_99999999999999999999.t")]
    claims = [("b", i, "a.t" if i % 3 else f"o{i % 9}.t") for i in range(600)] + [("b", 600 + i, "c") for i in range(4)]
    names, expected = {t for _, t in disk}, {}
    for _, i, target in claims:
        final, n = target, 0
        stem, dot, suffix = target.partition(".")
        while final in names:
            n += 1
            final = f"{stem}_{n}{dot}{suffix}"
        names.add(final)
        expected[i] = final
    held = {t for _, t in disk}
    seen, rows = set(held), []
    for b, i, target in claims:
        rows.append((b, i, target, target in seen))
        seen.add(target)
    got = rename_targets(
        spark.createDataFrame(rows, "bundle_id string, entry_idx bigint, target string, taken boolean"),
        spark.createDataFrame(disk, "bundle_id string, target string"))
    assert {r.entry_idx: r.final for r in got.collect()} == expected


def test_many_mappings(spark):
    files = spark.range(3000).select(F.format_string("Src\\d%d/F%d.py", F.col("id") % 7, F.col("id")).alias("file"), F.col("id").alias("ord"))
    maps = spark.range(10_000).select(F.col("id").alias("m"), F.format_string("f%d.PY", F.col("id")).alias("old"), F.format_string("%d.py", F.col("id")).alias("new"))
    got = {r.key: (r.file_old, r.file_new) for r in map_files(files, files, maps).collect()}
    assert len(got) == 3000 and got["f1.PY | 1.py"] == ("Src\\d1/F1.py", "Src\\d1/F1.py") and got["f2999.PY | 2999.py"][1].endswith("F2999.py")


def test_parts_by_broadcast_bounds(spark, monkeypatch):
    """Under a limit from which bounds are broadcast: the same cuts, nulls and repeats of a position included."""
    rng = random.Random(8)
    rows = [(b, i * 500, "x" * rng.choice([1, 10, 30, 60, 90, 300])) for b in ("a", "b") for i in range(200)]
    df = spark.createDataFrame([*rows, ("small", 0, "s")], "bundle_id string, entry_idx bigint, block string")
    shown = lambda out: sorted((r.bundle_id, r.part_no, r.in_parts, r.text) for r in out.collect())
    before = [shown(assemble(df, "--", limit)) for limit in (100, 1000)]
    monkeypatch.setattr(formatting, "BROADCAST_FROM", 1)
    assert [shown(assemble(df, "--", limit)) for limit in (100, 1000)] == before
    odd = spark.createDataFrame([("n", 0, None), ("n", 1, "x" * 40), ("n", 2, None), ("n", 3, "y" * 40), ("n", 3, "z" * 40), (None, 0, "o")], df.schema)
    found = shown(assemble(odd.filter("bundle_id = 'n'"), "--", 60))
    assert all(in_parts for _, _, in_parts, _ in found)
    assert sorted("--".join(t for *_, t in found if t).split("--")) == ["x" * 40, "y" * 40, "z" * 40]
    assert shown(assemble(odd.filter("bundle_id IS NULL"), "--", 60)) == [(None, 0, False, "o")]


def test_texts_shuffled_once_into_parts(spark):
    rows = [("a", i, "x" * 300_000) for i in range(8)]
    blocks = spark.createDataFrame(rows, "bundle_id string, entry_idx bigint, block string")
    parts = assemble(blocks, "", 1024 * 1024)
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert [len(r.text) for r in sorted(parts.collect(), key=lambda r: r.part_no)] == [600_000] * 3 + [300_000] * 2


@pytest.mark.parametrize("profile", ["plain_marker", "md_fence"])
def test_parts_as_they_were_written(spark, profile):
    """Their texts are not joined by number first; once they are united they are, and failed bundles go."""
    rows = [(b, i, f"p{i % 25 if b == 'twice' else i}", f"{b} {i}\n" * 5, "utf-8", False, "LF") for b in ("one", "two", "twice") for i in range(30)]
    entries = spark.createDataFrame(rows, ENTRY)
    parts = checkpoint(format_bundles(entries, profile, max_bytes=400)).filter("in_parts")
    assert _apart(parts) and not _apart(parts.unionByName(parts)) and not _apart(parts.withColumn("part_no", F.col("part_no") + 0))
    shown = lambda df: sorted((r.bundle_id, r.path, r.content) for r in df.collect())
    written = shown(parse_bundles(parts, profile))
    plain = parts.withColumn("part_no", F.col("part_no") + 0)
    assert written == shown(parse_bundles(plain, profile)) == shown(parse_bundles(parts))
    assert len(written) == (85 if profile == "plain_marker" else 60)
    if profile == "md_fence":
        plan = parse_bundles(parts.select("bundle_id", "part_no", "in_parts", "text"), profile)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list(text" not in plan and "row_number" not in plan


def test_many_failed_bundles(spark, monkeypatch):
    rows = [(b, i, "p", "x\n" * 50, "utf-8", False, "LF") for b in ("c", "d", "e") for i in range(9)]
    rows += [("ok", i, f"p{i}", "x\n" * 50, "utf-8", False, "LF") for i in range(9)]
    parts = checkpoint(format_bundles(spark.createDataFrame(rows, ENTRY), "md_fence", max_bytes=400))
    for most in (1000, 2, 0):
        monkeypatch.setattr(parsing, "FAILED_IDS", most)
        assert {r.bundle_id for r in parse_bundles(parts, "md_fence").collect()} == {"ok"}


def test_stored(spark):
    df = spark.createDataFrame([("a", 1, "x" * 3000), ("b", 2, None)], "k string, n bigint, t string").withMetadata("n", {"mark": True})
    back = stored(df, "rows")
    assert sorted(back.collect()) == sorted(df.collect()) and back.schema["n"].metadata == {"mark": True}


def test_round_trip_in_parts(spark, tmp_path):
    """No cell holds much of a bundle, and all files of it are read back."""
    text = "line of a document\n" * 5000
    rows = [(i, text[: 20_000 + i * 37 % 9000] if i % 10 else None, "en", f"s{i // 300}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    cells = []
    real = bundle_queries.stored

    def seen(df, what):
        out = real(df, what)
        cells.extend(out.select("bundle_id", "in_parts", F.octet_length("text").alias("n")).collect())
        return out

    bundle_queries.stored = seen
    try:
        got = sorted(bundle_queries.round_trip(spark, str(tmp_path)).collect())
    finally:
        bundle_queries.stored = real
    assert [(r.bundle_id, r.files, r.exact) for r in got] == [("s0", 270, True), ("s1", 90, True)]
    assert len(cells) > 4 and max(c.n for c in cells) <= 2 * 1024 * 1024 and any(c.in_parts for c in cells)
