"""Formats against line-by-line models written for these tests."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sheaf.plans.formatting import convert_bundles, format_blocks, format_bundles
from sheaf.plans.parsing import parse_bundles, parse_errors, parse_parts, validate_bundles
from sheaf.profiles import FenceProfile, PlainProfile, Profile, ProfileRegistry, default_registry
from sheaf.profiles.base import ProfileNotFound

ENTRY = "bundle_id string, entry_idx bigint, path string, content string, encoding string, is_binary boolean, eol_style string"


def bundles(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "bundle_id string, text string")


def parsed(df):
    out = {}
    for r in df.orderBy("bundle_id", "entry_idx").collect():
        out.setdefault(r.bundle_id, []).append((r.path, r.content))
    return out


def marker(line, keyword):
    """What stands behind ``# KEYWORD:``, or None. At least one character other than a line feed does."""
    rest = line.lstrip()
    for piece in ("#", keyword, ":"):
        if rest[:len(piece)].upper() != piece:
            return None
        rest = rest[len(piece):] if piece == ":" else rest[len(piece):].lstrip()
    return rest.strip() if rest.removesuffix("\n") else None


def is_rule(line):
    text = line.strip()
    dashes = text[1:].lstrip()
    return text[:1] == "#" and len(dashes) >= 10 and not dashes.strip("=")


def header(line):
    """The path of ``<!-- FILE: path; more -->``, or None."""
    text = line.strip()
    if not (text.startswith("<!--") and text.endswith("-->")):
        return None
    inner = text[4:-3].lstrip()
    path, semicolon, more = inner[5:].partition(";")
    return path.strip() if inner[:5].upper() == "FILE:" and path and semicolon and more else None


def opens(line):
    text = line.strip()
    return text.startswith("```") and (text == "```" or text[3:].replace("_", "a").isalnum())


def plain_model(text):
    """Blocks of the marker format: bodies collected by path, the last block of a path wins."""
    blocks, body = {}, None
    for line in text.splitlines(keepends=True):
        path = marker(line, "FILE")
        if path is not None:
            body = []
            if path not in ("", ".", "./", ".\\", "/"):
                path = path.replace("\\", "/")
                blocks.pop(path, None)
                blocks[path] = body
        elif body is not None and marker(line, "META") is None and not is_rule(line):
            body.append(line)

    def finished(lines):
        whole = "".join(lines)
        if not whole.strip():
            return ""
        return whole[:-1] if whole.endswith("\n\n") else whole

    return [(path, finished(lines)) for path, lines in blocks.items()]


def fence_model(text):
    """Blocks of the fence format: the lines between an opening and a bare fence below a header."""
    blocks, state = [], "before"
    for line in text.splitlines(keepends=True):
        path = header(line)
        if path is not None:
            blocks.append((path, []))
            state = "outside"
        elif state == "outside" and opens(line):
            state = "inside"
        elif state == "inside":
            if line.strip() == "```":
                state = "outside"
            else:
                blocks[-1][1].append(line)
    return [(path, "".join(lines).removesuffix("\n")) for path, lines in blocks]


def test_plain_random(spark):
    rng = random.Random(3)
    pieces = ["# FILE: a", " #file :b\\c ", "# FILE: ./", "# FILE:", "# FILE: ", "# META: x=1", "# META:", "text",
              "", "# ==========", "#=====", "  # ============ ", "x # FILE: no", "\t", "# FILE: d.md", "\u3000#\xa0FILE:\u2003e"]
    ends = ["\n"] * 6 + ["\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\u2028"]
    texts = ["".join(rng.choice(pieces) + rng.choice(ends) for _ in range(rng.randint(1, 14))) + rng.choice(["", "tail"])
             for _ in range(1500)]
    got = parsed(parse_bundles(bundles(spark, texts), "plain_marker"))
    wrong = [(t, got.get(str(i), []), plain_model(t)) for i, t in enumerate(texts) if got.get(str(i), []) != plain_model(t)]
    assert not wrong, wrong[:3]


def test_fence_random(spark):
    rng = random.Random(5)
    pieces = ["<!-- FILE: {n}; a=1 -->", " <!--file:{n};-->", "<!-- FILE: {n} -->", "<!-- FILE: {n}; m --> ", "```", "```py",
              "  ```  ", "``` x", "text", "", "````", "x```"]
    ends = ["\n"] * 8 + ["\r\n", "\r", "\x0c", "\u2029"]
    texts = ["".join(rng.choice(pieces).format(n=f"p{k}") + rng.choice(ends) for k in range(rng.randint(1, 16))) + rng.choice(["", "```", "tail"])
             for _ in range(1500)]
    got = parsed(parse_bundles(bundles(spark, texts), "md_fence"))
    wrong = [(t, got.get(str(i), []), fence_model(t)) for i, t in enumerate(texts) if got.get(str(i), []) != fence_model(t)]
    assert not wrong, wrong[:3]


def test_detection_random(spark):
    rng = random.Random(9)
    pieces = ["# FILE: a", "<!-- FILE: a; b=1 -->", "```py", "text", "", "#FILE:", "x" * 300]
    texts = ["".join(rng.choice(pieces) + rng.choice(["\n", "\n", "\r\n", "\r", "\x0b"]) for _ in range(rng.randint(0, 40)))
             for _ in range(800)]

    def model(text):
        text = text[:2048]
        if any(marker(x, "FILE") is not None for x in text.splitlines()[:20]):
            return "plain_marker"
        lines = text.split("\n")[:30]
        return "md_fence" if any(header(x) is not None for x in lines) and any(map(opens, lines)) else None

    df = bundles(spark, texts).select("bundle_id", default_registry().detect(F.col("text")).alias("p"))
    got = {r.bundle_id: r.p for r in df.collect()}
    assert [got[str(i)] for i in range(len(texts))] == [model(t) for t in texts]


def test_defaults_and_metadata(spark):
    texts = [
        "# FILE: a\n# META: mode=binary\nAA==\n# FILE: b\n# META: ENCODING=Base64\nAA\n# FILE: c\n# META: eol=CRLF; trailing=false\nx\n\n# FILE: d\ny",
        "<!-- FILE: a; mode=binary -->\n```\nAA\n```\n<!-- FILE: b; encoding=BASE64; eol= ; mode=binary -->\n```\nAA\n```",
    ]
    rows = parse_bundles(bundles(spark, texts)).orderBy("bundle_id", "entry_idx").collect()
    assert [(r.path, r.encoding, r.is_binary, r.eol_style, r.content) for r in rows] == [
        ("a", "base64", True, "n/a", "AA==\n"), ("b", "base64", True, "n/a", "AA\n"),
        ("c", "utf-8", False, "CRLF", "x"), ("d", "utf-8", False, "LF", "y"),
        ("a", "utf-8", True, "LF", "AA"), ("b", "BASE64", True, "n/a", "AA"),
    ]


def test_errors_are_rows(spark):
    texts = ["# FILE: a\n# META: eol=??\n", "# just text", "<!-- FILE: a; x -->\n```\n```\n<!-- FILE: a; x -->\n```\n```",
             "<!-- FILE: ; x -->\n```\n```", "# FILE: ok\nx"]
    df = bundles(spark, texts)
    problems = {r.bundle_id: r.problem for r in parse_errors(df).collect()}
    assert set(problems) == {"0", "1", "2", "3"}
    assert "Invalid eol_style: ??" in problems["0"] and "auto-detect" in problems["1"]
    assert "Duplicate file paths found: {'a'}" in problems["2"] and "cannot be empty" in problems["3"]
    report = {r.bundle_id: r for r in validate_bundles(df).collect()}
    assert report["4"].valid and report["4"].file_count == 1 and report["4"].errors == []
    unknown = validate_bundles(df, "zip").first()
    assert not unknown.valid and "Profile 'zip' not found" in unknown.errors[0]
    none = {r.bundle_id: r for r in validate_bundles(df, "plain_marker").collect()}["1"]
    assert none.errors == ["Parse error: No files found in bundle"] and none.profile == "plain_marker"


ROUND = ["print('x')\n", "no newline", "", "a\r\nb\r\n", "tab\t\u00e9\u4e16\n", "\n\nx\n\n", "line\n" * 80000]


def entries(spark, contents):
    rows = [("b", i, f"f{i}.py", c, "utf-8", False, "LF") for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, ENTRY)


def test_fence_round_trip_is_exact(spark):
    back = parse_bundles(format_bundles(entries(spark, ROUND), "md_fence"))
    assert [c for _, c in parsed(back)["b"]] == ROUND


def test_plain_round_trip_normalises_ends(spark):
    back = parsed(parse_bundles(format_bundles(entries(spark, ROUND), "plain_marker")))["b"]
    assert [c for _, c in back] == [ROUND[0], "no newline\n", "", ROUND[3], ROUND[4], "\n\nx\n", ROUND[6]]


def test_many_files(spark):
    out = format_bundles(entries(spark, [f"content {i}\n" for i in range(100)]), "plain_marker")
    assert len(parsed(parse_bundles(out))["b"]) == 100


def test_parts_add_up(spark):
    e = entries(spark, [f"content {i}\n" * (i % 7) for i in range(60)])
    whole = format_bundles(e, "md_fence").first().text
    parts = format_bundles(e, "md_fence", max_bytes=700)
    rows = parts.orderBy("part_no").collect()
    assert len(rows) > 3 and all(r.in_parts for r in rows) and all(len(r.text) <= 700 for r in rows)
    assert "\n\n".join(r.text for r in rows) == whole
    assert parsed(parse_bundles(parts)) == parsed(parse_bundles(format_bundles(e, "md_fence")))


def test_parts_settle_duplicates_and_errors(spark):
    rows = [("a", "plain_marker", 0, "# FILE: x\n1\n"), ("a", "plain_marker", 1, "# FILE: x\n2\n# FILE: y\n3\n"),
            ("b", "md_fence", 0, "<!-- FILE: x; a=1 -->\n```\n1\n```"), ("b", "md_fence", 1, "<!-- FILE: x; a=1 -->\n```\n1\n```"),
            ("c", "plain_marker", 0, "# FILE: x\n# META: eol=no\n1\n"), ("c", "plain_marker", 1, "# FILE: z\n1\n")]
    df = spark.createDataFrame(rows, "bundle_id string, profile string, part_no bigint, text string")
    assert parsed(parse_parts(df)) == {"a": [("x", "2\n"), ("y", "3\n")]}


def test_lossy_flag_and_problems(spark):
    e = entries(spark, ["fine\n", "# FILE: inner\n", "# ==========\n", "```\n"])
    flags = [r.lossy for r in format_blocks(e, "plain_marker").orderBy("entry_idx").collect()]
    assert flags == [False, True, True, False]
    assert [r.lossy for r in format_blocks(e, "md_fence").orderBy("entry_idx").collect()] == [False] * 3 + [True]
    bare = e.withColumn("encoding", F.lit(""))
    with pytest.raises(PySparkException, match="missing encoding"):
        format_blocks(bare, "md_fence").collect()
    assert format_blocks(bare, "md_fence", on_problem="drop").count() == 0
    kept = format_blocks(bare, "md_fence", on_problem="quarantine").collect()
    assert all(r.block is None and "missing encoding" in r.problem for r in kept)
    assert format_blocks(bare, "plain_marker").filter("block LIKE '%encoding=utf-8;%'").count() == 4


def test_convert(spark):
    out = convert_bundles(bundles(spark, ["# FILE: a.py\nx\n"]), "md_fence").first()
    assert out.text == "<!-- FILE: a.py; encoding=utf-8; eol=LF; mode=text -->\n```python\nx\n\n```"


class Upper(Profile):
    """``@path|content`` lines."""

    name = "at_lines"
    capabilities = {"supports_binary": False}

    def detect(self, text):
        return F.startswith(text, F.lit("@"))

    def split(self, text):
        return F.split(text, "\n", -1)

    def path(self, block):
        return F.regexp_extract(block, r"^@([^|]*)", 1)

    def meta(self, block):
        return F.lit("")

    def body(self, block):
        return F.regexp_extract(block, r"\|(.*)$", 1)

    def fields(self, meta):
        return F.array().cast("array<string>"), F.array().cast("array<string>")

    def finish(self, path, body, get):
        return {"path": path, "content": body, "encoding": F.lit("utf-8"), "is_binary": F.lit(False), "eol_style": F.lit("LF")}


def test_plug_in(spark):
    registry = default_registry()
    registry.register(Upper())
    assert registry.list_profiles() == ["at_lines", "md_fence", "plain_marker"]
    got = parse_bundles(bundles(spark, ["@a|1\n@b|2", "# FILE: c\n3"]), registry=registry)
    assert parsed(got) == {"0": [("a", "1"), ("b", "2")], "1": [("c", "3")]}
    assert Upper().title() == "At Lines" and PlainProfile().supports("supports_binary")
    assert not Upper().supports("other") and not FenceProfile().supports(None)
    with pytest.raises(TypeError):
        registry.register(object())
    with pytest.raises(ProfileNotFound, match="not found. Available profiles"):
        registry.get("nope")
    with pytest.raises(ValueError):
        parse_bundles(bundles(spark, ["x"]), auto_detect=False)
    assert ProfileRegistry().all() == []
