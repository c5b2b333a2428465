import binascii

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sheaf.functions import content as C
from sheaf.functions import paths as P
from sheaf.functions.text import SPACES, human_size, split_lines, strip
from sheaf.operators import manifest as M


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_sanitize(spark):
    cases = {
        'file<>:"|?*.txt': "file_______.txt", "  .hidden ": "hidden",
        "src/.././main.py": "src___..___.___main.py", ".../   ": "unnamed___unnamed", "": "unnamed",
        "   ": "unnamed", "...": "unnamed", " leading/trailing ": "leading___trailing",
        "a/b\\c": "a___b___c", " .git/config ": "git___config", "../../../evil": "..___..___..___evil",
    }
    assert values(spark, [*cases, None], P.sanitize_filename) == [*cases.values(), "unnamed"]


def test_traversal(spark):
    paths = ["../file", "~/file", "//share/file", "a\\\\b", "normal/file"]
    assert values(spark, paths, P.has_traversal) == [True, True, True, True, False]


def test_path_problem(spark):
    paths = ["a/b", "../x", "a/../../x", "/etc/passwd", "C:\\x", "\\x", "a/../b", "..x"]
    got = values(spark, paths, P.path_problem)
    assert [g is None for g in got] == [True, False, False, False, False, False, True, True]
    assert values(spark, ["/a"], lambda c: P.path_problem(c, allow_absolute=True)) == [None]


def test_resolve(spark):
    paths = ["a/./b/../../../c", "/x/y", "a\\b", "..", "a//b", ".hidden/x", "a/..b"]
    got = values(spark, paths, P.resolve)
    assert [(g.path, g.escaped) for g in got] == [
        ("c", True), ("x/y", False), ("a/b", False), ("", True), ("a/b", False),
        (".hidden/x", False), ("a/..b", False),
    ]


def test_names(spark):
    assert values(spark, ["a/b.tar.gz", ".bashrc", "x/y.", "z"], P.suffix) == [".gz", "", "", ""]
    assert values(spark, ["a/b.tar.gz", ".bashrc"], P.stem) == ["b.tar", ".bashrc"]


def test_order_is_by_component(spark):
    df = spark.createDataFrame([("a-b/x",), ("a/x",), ("a",)], "p string")
    assert [r.p for r in df.orderBy(P.order_key(F.col("p"))).collect()] == ["a", "a/x", "a-b/x"]


def test_eol(spark):
    texts = ["a\nb", "a\r\nb", "a\rb", "a\nb\r\n", "a\r\nb\rc", "plain", "", "\r\r\n"]
    assert values(spark, texts, C.eol_style) == ["LF", "CRLF", "CR", "MIXED", "MIXED", "LF", "LF", "MIXED"]


def test_sniff(spark):
    def sniff(b):
        if 0 in b[:1024]:
            return True
        try:
            b[:1024].decode()
            return False
        except UnicodeDecodeError as e:
            return not (len(b) > 1024 and e.reason == "unexpected end of data")

    cases = [
        b"Hello", "Hello, 世界!".encode(), b"\x89PNG\r\n\x1a\n", b"some\x00binary", b"",
        b"a" * 1023 + "é".encode(), b"a" * 1022 + "世".encode(), b"a" * 1021 + "😀".encode(),
        b"a" * 1023 + "😀".encode(), b"a" * 1023 + b"\xc3", b"a" * 1024 + b"\x00", b"a" * 1023 + b"\xff\xff",
    ]
    assert values(spark, [bytearray(c) for c in cases], C.is_binary, "binary") == [sniff(c) for c in cases[:9]] + [True, False, True]
    assert values(spark, [bytearray(cases[5])], lambda c: C.is_binary(c, True), "binary") == [True]


def test_decode(spark):
    cases = [b"ok \xef\xbf\xbd", b"\xff\xfe\xe4\xb8", b"a\xc3(b", "é".encode()]
    rows = [bytearray(c) for c in cases]
    assert values(spark, rows, C.decode_replace, "binary") == [c.decode("utf-8", "replace") for c in cases]
    assert values(spark, rows, C.decode_ignore, "binary") == [c.decode("utf-8", "ignore") for c in cases]


def test_base64(spark):
    long = bytes(range(256)) * 3
    assert values(spark, [bytearray(long)], C.to_base64, "binary")[0].count("\n") == 0
    got = values(spark, ["!!YQ==", "YQ", " YQ==\n", "YW\nJj"], C.from_base64)
    assert [g and bytes(g) for g in got] == [b"a", None, b"a", b"abc"]


def test_base64_is_decoded_in_one_pass(spark):
    """As the standard library reads it, and without a pattern that meets every character."""
    cases = ["", "=YQ==", "YQ=", "YQ==YQ==", "Y=Q==", "YWJ=j", "YWJjx", "YWJj====", "Y\u00e9W\u20acJ\U0001f600j", "A", "\x00YQ==\x00"]

    def plain(text):
        try:
            return binascii.a2b_base64(text.encode())
        except ValueError:
            return None

    got = values(spark, [*cases, None], C.from_base64)
    assert [g if g is None else bytes(g) for g in got] == [*map(plain, cases), None]
    df = spark.createDataFrame([("YQ==",)], "v string")
    plan = df.select(C.from_base64(F.col("v")), C.to_base64(F.col("v").cast("binary")))._jdf.queryExecution().toString()
    assert "regexp_replace" not in plan and "translate" not in plan


def test_charsets(spark):
    df = spark.createDataFrame(
        [("é€☃", e) for e in ("utf-8", "auto", "UTF8-BOM", "windows-1252", "nope", None)], "t string, e string"
    )
    got = [r[0] and bytes(r[0]) for r in df.select(C.encode_text(F.col("t"), F.col("e"))).collect()]
    assert got == ["é€☃".encode()] * 2 + ["é€☃".encode("utf-8-sig"), b"\xe9\x80?", None, "é€☃".encode()]


def test_checksums(spark):
    import hashlib

    digest = hashlib.sha256(b"abc").hexdigest()
    df = spark.createDataFrame([("abc", digest.upper()), ("abc", None), ("abd", digest)], "t string, e string")
    assert [r[0] for r in df.select(C.verify_checksum(F.col("t"), F.col("e"))).collect()] == [True, True, False]


def test_sizes(spark):
    assert values(spark, [0, 1023, 1024, 1536, 1048576, 10_000_000], human_size, "bigint") == [
        "0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "9.5 MB"]
    with pytest.raises(ValueError):
        C.over_limit_mb(F.lit(1), 0)


def test_lines_and_strip(spark):
    texts = ["a\nb\r\nc\rd\x0be\x0cf\x1cg\x1dh\x1ei\x85j\u2028k\u2029l", "x\n", "", "\n\n"]
    assert values(spark, texts, split_lines) == [t.splitlines() for t in texts]
    padded = SPACES + "a b" + SPACES
    assert values(spark, [padded], strip) == ["a b"] and padded.strip() == "a b"


def test_oversized_stops(spark):
    files = spark.createDataFrame([("b", "a.txt", 2 * 1024 * 1024, bytearray(b"x"))], "bundle_id string, path string, length bigint, content binary")
    with pytest.raises(PySparkException, match="exceeds limit"):
        M.create_manifest(files, max_file_mb=1).collect()
    assert M.create_manifest(files, max_file_mb=1, oversized="drop").count() == 0
    binary = files.withColumn("content", F.lit(bytearray(b"\x00")))
    with pytest.raises(PySparkException, match="binary handling is disabled"):
        M.create_manifest(binary, binary_as_base64=False).collect()
