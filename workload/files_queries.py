"""Scans, paths, globs, content and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import content as C
from sheaf.functions import paths as P
from sheaf.functions.globs import DEFAULT_DENY, GlobFilter, pattern_problem
from sheaf.functions.text import human_size, last_field, meta_fields
from sheaf.operators import manifest as M
from sheaf.profiles.fence import language_hint
from sheaf.profiles import Profile, ProfileRegistry
from workload import inputs as I
from workload.registry import query

_PATH, _TEXT = I.check_sql(I.FILE_PATH), I.check_sql(I.FILE_TEXT)
FILES = (
    f"files AS (SELECT doc_id, source AS bundle_id, {_PATH} AS path, "
    f"'/data/' || source || '/' || {_PATH} AS abs_path, {_TEXT} AS text, "
    f"{I.check_sql(I.FILE_BYTES)} AS content FROM documents), "
    "sized AS (SELECT *, octet_length(content) AS length FROM files), "
    "sniffed AS (SELECT *, regexp_matches(hex(content[1:1024]), '^(..)*00') OR NOT ("
    "try(decode(content[1:1024])) IS NOT NULL OR length > 1024 AND ("
    "try(decode(content[1:1023])) IS NOT NULL OR try(decode(content[1:1022])) IS NOT NULL "
    "OR try(decode(content[1:1021])) IS NOT NULL)) AS is_binary, "
    "CASE WHEN doc_id % 13 = 7 THEN text || chr(65533) || '(' || chr(65533) ELSE text END AS decoded "
    "FROM sized), "
    "entries AS (SELECT bundle_id, path, abs_path, doc_id, length, is_binary, "
    "CASE WHEN is_binary THEN base64(content) ELSE decoded END AS content, "
    "CASE WHEN is_binary THEN 'base64' ELSE 'utf-8' END AS encoding, "
    "CASE WHEN is_binary THEN 'n/a' ELSE eol END AS eol_style, "
    "row_number() OVER (PARTITION BY bundle_id ORDER BY string_split(path, '/')) - 1 AS entry_idx "
    "FROM (SELECT *, CASE WHEN (crlf > 0)::INT + (lf > crlf)::INT + (cr > crlf)::INT > 1 THEN 'MIXED' "
    "WHEN crlf > 0 THEN 'CRLF' WHEN cr > 0 THEN 'CR' ELSE 'LF' END AS eol "
    "FROM (SELECT *, len(string_split(decoded, chr(13) || chr(10))) - 1 AS crlf, "
    "len(string_split(decoded, chr(10))) - 1 AS lf, len(string_split(decoded, chr(13))) - 1 AS cr "
    "FROM sniffed)))"
)
_DENIED = "(regexp_matches(path, '(^|/)(\\.git|__pycache__|build)/') OR path LIKE '%.log')"
PAGES = f"pages2 AS (SELECT page_id, {I.check_sql(I.PAGE_PATH)} AS path FROM pages)"


def manifest(spark, sf):
    return M.create_manifest(I.numbered_files(spark, sf))


# -- scans and order
@query("discovery_order", f"""
WITH {FILES}
SELECT bundle_id, path, row_number() OVER (PARTITION BY bundle_id ORDER BY string_split(path, '/')) - 1 AS entry_idx
FROM files WHERE NOT {_DENIED}""")
def discovery_order(spark, sf):
    listing = I.files(spark, sf).select("bundle_id", "path")
    return M.number_files(listing.filter(GlobFilter(None, DEFAULT_DENY).includes(F.col("path"))))


@query("unique_files", f"""
WITH {FILES} SELECT bundle_id, count(*) AS files FROM (SELECT DISTINCT bundle_id, abs_path FROM files) GROUP BY 1""")
def unique_files(spark, sf):
    twice = I.files(spark, sf).select("bundle_id", "abs_path")
    seen = M.union_sources([twice, twice.filter("abs_path LIKE '%.md'")])
    return seen.dropDuplicates(["abs_path"]).groupBy("bundle_id").agg(F.count("*").alias("files"))


@query("multi_source", f"""
WITH {FILES} SELECT source_ord, count(*) AS files FROM (
SELECT 0 AS source_ord FROM files WHERE path LIKE '%.md' UNION ALL
SELECT 1 AS source_ord FROM files WHERE path LIKE '%.py' OR path LIKE '%.md') GROUP BY 1""")
def multi_source(spark, sf):
    f = I.files(spark, sf).select("path")
    md, both = F.col("path").like("%.md"), F.rlike("path", F.lit(r"\.(py|md)$"))
    return M.union_sources([f.filter(md), f.filter(both)]).groupBy("source_ord").agg(
        F.count("*").alias("files")
    )


@query("python_sources", f"WITH {FILES} SELECT bundle_id, path FROM files WHERE lower(path) LIKE '%.py'")
def python_sources(spark, sf):
    from sheaf.sources.filetree import python_files

    return python_files(I.files(spark, sf).select("bundle_id", "path", "abs_path")).select(
        "bundle_id", "path"
    )


# -- globs
@query("glob_filter", f"""
WITH {FILES} SELECT path, bundle_id, NOT {_DENIED} AS by_default,
NOT (regexp_matches(path, '(^|/)doc_1.\\.[^/]*$') OR regexp_matches(path, '(^|/)build/'))
AND (path LIKE '%.py' OR path LIKE 'src%/%.md' OR regexp_matches(path, '[57]$')) AS by_rules FROM files""")
def glob_filter(spark, sf):
    rules = GlobFilter(["**/*.py", "src*/**/*.md", "*[57]"], ["doc_1?.*", "**/build/**"])
    p = F.col("path")
    return I.files(spark, sf).select(
        "path", "bundle_id", GlobFilter(None, DEFAULT_DENY).includes(p).alias("by_default"),
        rules.includes(p).alias("by_rules"),
    )


@query("glob_filter_base", f"""
WITH {FILES} SELECT abs_path FROM files WHERE CASE WHEN bundle_id = 'src1'
THEN NOT path LIKE 'build/%' AND (path LIKE '%.md' OR path LIKE '%.py') ELSE path LIKE '%.py' END""")
def glob_filter_base(spark, sf):
    rules = GlobFilter(["src1/**/*.md", "*.py"], ["src1/build/**"])
    return I.files(spark, sf).select("abs_path").filter(
        rules.includes_under(F.col("abs_path"), "/data/src1")
    )


@query("pattern_problems", f"""
WITH {FILES}, p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '**/' || path WHEN 1 THEN '[' || path WHEN 2 THEN chr(9) || ' '
WHEN 3 THEN path || '[!a-c]*' WHEN 4 THEN NULL ELSE text END AS pattern FROM files)
SELECT doc_id, CASE WHEN pattern IS NULL OR trim(pattern, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'it is blank or no string'
WHEN length(replace(pattern, '[', '')) <> length(replace(pattern, ']', '')) THEN 'its brackets do not pair up' END AS problem FROM p""")
def pattern_problems(spark, sf):
    """Patterns kept in a table: paths with and without brackets, blanks, nulls and whole texts."""
    d = I.load(spark, sf, "documents").withColumn("path", F.expr(I.FILE_PATH)).withColumn("body", F.expr(I.FILE_TEXT))
    pattern = F.expr(
        "CASE doc_id % 6 WHEN 0 THEN '**/' || path WHEN 1 THEN '[' || path WHEN 2 THEN chr(9) || ' ' "
        "WHEN 3 THEN path || '[!a-c]*' WHEN 4 THEN NULL ELSE body END")
    return d.select("doc_id", pattern_problem(pattern).alias("problem"))


# -- paths
@query("path_safety", f"""
WITH {PAGES} SELECT page_id, path, page_id % 9 NOT IN (0, 1, 2, 3, 6) AS safe,
CASE WHEN page_id % 9 IN (0, 1, 6) THEN 'Absolute paths not allowed' WHEN page_id % 9 IN (2, 3) THEN 'Path escapes base directory' END AS reason
FROM pages2""")
def path_safety(spark, sf):
    return I.page_paths(spark, sf).select(
        "page_id", "path", P.is_safe_path(F.col("path")).alias("safe"),
        P.path_problem(F.col("path")).alias("reason"),
    )


@query("resolve_target", f"""
WITH {PAGES} SELECT page_id, page_id % 9 IN (2, 3) AS escaped,
CASE page_id % 9 WHEN 0 THEN regexp_replace(substr(path, 2), '/+', '/', 'g') WHEN 1 THEN replace(path, chr(92), '/') WHEN 2 THEN substr(path, 4)
WHEN 3 THEN 'page_' || page_id WHEN 4 THEN 'a/page_' || page_id WHEN 6 THEN 'host/page_' || page_id
ELSE replace(path, chr(92), '/') END AS target FROM (
SELECT page_id, CASE WHEN page_id % 9 = 0 THEN regexp_replace(path, '/$', '') ELSE path END AS path FROM pages2)""")
def resolve_target(spark, sf):
    r = P.resolve(F.col("path"))
    return I.page_paths(spark, sf).select(
        "page_id", r["escaped"].alias("escaped"), r["path"].alias("target")
    )


@query("traversal_flags", f"""
WITH {PAGES} SELECT page_id, strpos(path, '..') > 0 OR strpos(path, '~') > 0 OR strpos(path, '//') > 0
OR strpos(path, chr(92) || chr(92)) > 0 AS suspicious FROM pages2""")
def traversal_flags(spark, sf):
    return I.page_paths(spark, sf).select(
        "page_id", P.has_traversal(F.col("path")).alias("suspicious")
    )


@query("sanitize_filename", """
SELECT page_id, array_to_string(list_transform(
string_split_regex(translate(url, '<>:"|?*', '_______'), '[/\\\\]'),
lambda c: CASE WHEN c IN ('.', '..') THEN c WHEN trim(c, ' .') = '' THEN 'unnamed' ELSE trim(c, ' .') END), '___') AS name
FROM pages""")
def sanitize_filename(spark, sf):
    return I.load(spark, sf, "pages").select(
        "page_id", P.sanitize_filename(F.col("url")).alias("name")
    )


@query("name_parts", f"""
WITH {FILES} SELECT path, bundle_id, string_split(path, '/')[-1] AS name,
regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem,
regexp_extract(path, '(\\.[A-Za-z]+)$', 1) AS suffix, regexp_extract(path, '^(.*)/', 1) AS parent FROM files""")
def name_parts(spark, sf):
    p = F.col("path")
    return I.files(spark, sf).select(
        "path", "bundle_id", P.base_name(p).alias("name"), P.stem(p).alias("stem"),
        P.suffix(p).alias("suffix"), P.parent(p).alias("parent"),
    )


@query("relative_path", f"""
WITH {FILES} SELECT abs_path, CASE WHEN bundle_id = 'src2' THEN path END AS path, abs_path LIKE '/data/src2/%' AS inside FROM files""")
def relative_path(spark, sf):
    a = F.col("abs_path")
    return I.files(spark, sf).select(
        "abs_path", P.relative_to(a, "/data/src2").alias("path"),
        P.is_within(a, "/data/src2").alias("inside"),
    )


@query("separators", f"WITH {PAGES} SELECT page_id, replace(path, chr(92), '/') AS path FROM pages2")
def separators(spark, sf):
    return I.page_paths(spark, sf).select("page_id", P.to_posix(F.col("path")).alias("path"))


@query("language_hint", f"""
WITH {FILES} SELECT path, bundle_id, CASE lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1)) WHEN 'py' THEN 'python'
WHEN 'json' THEN 'json' WHEN 'sh' THEN 'shell' WHEN 'yaml' THEN 'yaml' END AS hint FROM files""")
def hints(spark, sf):
    return I.files(spark, sf).select("path", "bundle_id", language_hint(F.col("path")).alias("hint"))


# -- sizes
@query("size_label", """
SELECT doc_id, CASE WHEN n * 900 < 1024 THEN CAST(n * 900 AS VARCHAR) || ' B'
WHEN n * 900 < 1048576 THEN printf('%.1f KB', n * 900 / 1024.0) ELSE printf('%.1f MB', n * 900 / 1048576.0) END AS size_label
FROM (SELECT doc_id, length(text) AS n FROM documents)""")
def size_label(spark, sf):
    return I.load(spark, sf, "documents").select(
        "doc_id", human_size(F.length("text").cast("bigint") * 900).alias("size_label")
    )


@query("size_limit", f"""
WITH {FILES} SELECT path, bundle_id, length / 1048576.0 > 0.0017 AS over_mb, length > 1782 AS over_bytes FROM sized""")
def size_limit(spark, sf):
    n = F.col("length")
    return I.files(spark, sf).select(
        "path", "bundle_id", C.over_limit_mb(n, 0.0017).alias("over_mb"),
        C.over_limit_bytes(n, 0.0017).alias("over_bytes"),
    )


@query("oversized", f"WITH {FILES} SELECT path, length / 1048576.0 AS size_mb FROM sized WHERE length > 0.002 * 1048576")
def oversized(spark, sf):
    return M.oversized_files(I.files(spark, sf), 0.002)


# -- content
@query("detect_eol", f"""
WITH {FILES} SELECT doc_id, CASE WHEN (crlf > 0)::INT + (lf > crlf)::INT + (cr > crlf)::INT > 1 THEN 'MIXED'
WHEN crlf > 0 THEN 'CRLF' WHEN cr > 0 THEN 'CR' ELSE 'LF' END AS eol_style FROM (
SELECT doc_id, len(string_split(text, chr(13) || chr(10))) - 1 AS crlf, len(string_split(text, chr(10))) - 1 AS lf,
len(string_split(text, chr(13))) - 1 AS cr FROM files)""")
def detect_eol(spark, sf):
    return I.load(spark, sf, "documents").select(
        "doc_id", C.eol_style(F.expr(I.FILE_TEXT)).alias("eol_style")
    )


@query("binary_sniff", f"WITH {FILES} SELECT path, bundle_id, is_binary FROM sniffed")
def binary_sniff(spark, sf):
    return I.files(spark, sf).select(
        "path", "bundle_id", C.is_binary(F.col("content")).alias("is_binary")
    )


@query("binary_sniff_strict", f"""
WITH {FILES} SELECT path, bundle_id, regexp_matches(hex(content[1:1024]), '^(..)*00')
OR try(decode(content[1:1024])) IS NULL AS is_binary FROM files""")
def binary_sniff_strict(spark, sf):
    return I.files(spark, sf).select(
        "path", "bundle_id", C.is_binary(F.col("content"), strict_sniff=True).alias("is_binary")
    )


@query("decode_text", f"""
WITH {FILES} SELECT path, bundle_id,
sha256(CASE doc_id % 13 WHEN 0 THEN chr(65533) || 'PNG' || chr(13) || chr(10) || chr(0) || text WHEN 5 THEN chr(65533) || text ELSE decoded END) AS replaced,
sha256(CASE doc_id % 13 WHEN 0 THEN 'PNG' || chr(13) || chr(10) || chr(0) || text WHEN 7 THEN text || '(' ELSE text END) AS dropped
FROM sniffed""")
def decode_text(spark, sf):
    c = F.col("content")
    return I.files(spark, sf).select(
        "path", "bundle_id", F.sha2(C.decode_replace(c), 256).alias("replaced"),
        F.sha2(C.decode_ignore(c), 256).alias("dropped"),
    )


@query("base64_content", f"""
WITH {FILES} SELECT path, bundle_id, sha256(base64(content)) AS encoded, sha256(content) AS decoded,
length % 4 = 0 AS whole FROM sized""")
def base64_content(spark, sf):
    text = C.to_base64(F.col("content"))
    return I.files(spark, sf).select(
        "path", "bundle_id", F.sha2(text, 256).alias("encoded"),
        F.sha2(C.from_base64(F.concat(F.lit(" !"), text)), 256).alias("decoded"),
        (F.col("length") % 4 == 0).alias("whole"),
    )


@query("base64_errors", """
SELECT doc_id, length(k) % 4 = 0 AS decodes FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9+/=]', '', 'g') AS k FROM
(SELECT doc_id, replace(text, '=', '') AS text FROM documents))""")
def base64_errors(spark, sf):
    return I.load(spark, sf, "documents").select(
        "doc_id", C.from_base64(F.translate("text", "=", "")).isNotNull().alias("decodes")
    )


@query("base64_padding", """
WITH b AS (SELECT doc_id, text, base64(encode(text)) AS b FROM documents)
SELECT doc_id, sha256(CASE doc_id % 6 WHEN 3 THEN CASE WHEN suffix(b, '=') THEN text ELSE text || text END
WHEN 4 THEN CASE WHEN suffix(b, '=') THEN text END WHEN 5 THEN CASE WHEN NOT suffix(b, '=') THEN text END ELSE text END) AS decoded FROM b""")
def base64_padding(spark, sf):
    """Padding before the data, too much of it, in the middle, followed by more, and missing."""
    b = C.to_base64(F.col("text").cast("binary"))
    odd = (
        F.when(F.col("doc_id") % 6 == 1, F.concat(F.lit("="), b))
        .when(F.col("doc_id") % 6 == 2, F.concat(b, F.lit("=")))
        .when(F.col("doc_id") % 6 == 3, F.concat(b, b))
        .when(F.col("doc_id") % 6 == 4, F.concat(b, F.lit("x")))
        .when(F.col("doc_id") % 6 == 5, F.translate(b, "=", ""))
        .otherwise(b)
    )
    return I.load(spark, sf, "documents").select("doc_id", F.sha2(C.from_base64(odd), 256).alias("decoded"))


@query("encode_payload", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'UTF-8-BOM' WHEN 2 THEN 'auto'
ELSE CASE doc_id % 8 WHEN 7 THEN 'undefined' ELSE 'no-such-set' END END AS encoding,
CASE doc_id % 4 WHEN 1 THEN sha256(unhex('EFBBBF') || encode(text)) WHEN 3 THEN NULL ELSE sha256(text) END AS payload
FROM documents""")
def encode_payload(spark, sf):
    name = F.expr(
        "CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'UTF-8-BOM' WHEN 2 THEN 'auto' "
        "ELSE CASE doc_id % 8 WHEN 7 THEN 'undefined' ELSE 'no-such-set' END END"
    )
    return I.load(spark, sf, "documents").select(
        "doc_id", name.alias("encoding"),
        F.sha2(C.encode_text(F.col("text"), name), 256).alias("payload"),
    )


@query("encode_windows_1252", """
SELECT doc_id, sha256(unhex(array_to_string(list_transform(string_split(text || chr(8364) || chr(9731), ''),
lambda c: CASE WHEN unicode(c) = 8364 THEN '80' WHEN unicode(c) < 256 THEN printf('%02X', unicode(c)) ELSE '3F' END), ''))) AS payload
FROM documents""")
def encode_windows_1252(spark, sf):
    text = F.concat("text", F.lit("€☃"))
    return I.load(spark, sf, "documents").select(
        "doc_id", F.sha2(C.encode_text(text, F.lit("windows-1252")), 256).alias("payload")
    )


@query("checksum", f"""
WITH {FILES} SELECT path, bundle_id, sha256(content) AS file_sum, sha256(text) AS text_sum FROM files""")
def checksum(spark, sf):
    return I.load(spark, sf, "documents").select(
        F.expr(I.FILE_PATH).alias("path"), F.col("source").alias("bundle_id"),
        C.file_checksum(F.expr(I.spark_sql(I.FILE_BYTES))).alias("file_sum"),
        C.text_checksum(F.expr(I.FILE_TEXT)).alias("text_sum"),
    )


@query("verify_checksums", """
SELECT CAST(conv_id AS VARCHAR) AS bundle_id, turn AS entry_idx, turn % 10 <> 4 AS ok FROM conversations WHERE turn % 3 <> 2""")
def verify_checksums(spark, sf):
    """Two of three turns have a recorded digest, in upper case for some, and wrong for some."""
    c = I.load(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("bundle_id"), F.col("turn").alias("entry_idx"),
        F.concat(F.lit("turn_"), F.col("turn").cast("string")).alias("path"), F.col("text").alias("content"),
    )
    recorded = c.filter("entry_idx % 3 <> 2").select(
        "bundle_id", "path",
        F.when(F.col("entry_idx") % 10 == 4, F.sha2(F.concat("content", F.lit("!")), 256))
        .when(F.col("entry_idx") % 2 == 0, F.upper(F.sha2("content", 256)))
        .otherwise(F.sha2("content", 256)).alias("checksum"),
    )
    return M.verify_checksums(c, recorded).select(
        "bundle_id", F.regexp_extract("path", r"(\d+)$", 1).cast("bigint").alias("entry_idx"), "ok"
    )


@query("header_block", f"""
WITH {FILES} SELECT path, bundle_id, sha256('# ' || repeat('=', 76) || chr(10) || '# SOURCEFILE: ' || string_split(path, '/')[-1] || chr(10)
|| '# RELPATH: ' || path || chr(10) || '# PROJECT: demo' || chr(10) || '# TEAM: ' || chr(10) || '# VERSION: 1' || chr(10)
|| '# LIFECYCLE: Proposed' || chr(10) || '# DESCRIPTION:' || chr(10) || '#   (Content extracted from bundle)' || chr(10)
|| '# FIXES:' || chr(10) || '#   (If applicable, list fixes related to this file)' || chr(10) || '# ' || repeat('=', 76) || chr(10)) AS header FROM files""")
def header_block(spark, sf):
    return I.files(spark, sf).select(
        "path", "bundle_id",
        F.sha2(C.header_block(F.col("path"), project="demo", version="1"), 256).alias("header"),
    )


@query("meta_parse", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'latin-1' ELSE lang END AS plain_encoding, lang AS fence_encoding,
CASE WHEN doc_id % 2 = 0 THEN 'CRLF' END AS eol FROM documents""")
def meta_parse(spark, sf):
    meta = F.concat(
        F.lit("encoding = "), F.col("lang"), F.lit(" ;; mode=text"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN '; Encoding=latin-1' ELSE '' END"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN ';eol=LF;eol= CRLF ' ELSE '' END"),
    )
    plain, fence = meta_fields(F.col("meta"), lower_keys=True), meta_fields(F.col("meta"))
    return I.load(spark, sf, "documents").select("doc_id", meta.alias("meta")).select(
        "doc_id", last_field(*plain, "encoding").alias("plain_encoding"),
        last_field(*fence, "encoding").alias("fence_encoding"), last_field(*fence, "eol").alias("eol"),
    )


# -- manifests
@query("create_manifest", f"""
WITH {FILES} SELECT bundle_id, entry_idx, path, encoding, is_binary, eol_style, length AS file_size_bytes,
sha256(content) AS content_sum FROM entries""")
def create_manifest(spark, sf):
    return manifest(spark, sf).select(
        "bundle_id", "entry_idx", "path", "encoding", "is_binary", "eol_style", "file_size_bytes",
        C.text_checksum(F.col("content")).alias("content_sum"),
    )


@query("manifest_given_positions", f"""
WITH {FILES} SELECT bundle_id, doc_id AS entry_idx, path, encoding, sha256(content) AS content_sum FROM entries""")
def manifest_given_positions(spark, sf):
    """Files that come with positions of their own, whose paths are checked all the same."""
    d = I.load(spark, sf, "documents")
    files = d.select(
        F.col("source").alias("bundle_id"), F.expr(I.FILE_PATH).alias("path"), F.col("doc_id").alias("entry_idx"),
        F.expr(I.spark_sql(I.FILE_BYTES)).alias("content")).withColumn("length", F.octet_length("content").cast("bigint"))
    return M.create_manifest(files).select(
        "bundle_id", "entry_idx", "path", "encoding", C.text_checksum(F.col("content")).alias("content_sum"))


@query("text_only_manifest", f"""
WITH {FILES} SELECT bundle_id, path, sha256(regexp_replace(content, chr(13) || chr(10) || '?', chr(10), 'g')) AS content_sum,
'LF' AS eol_style
FROM entries WHERE NOT is_binary AND length <= 4194""")
def text_only_manifest(spark, sf):
    """Universal newlines, a size limit that leaves files out, and no binary files."""
    files = I.numbered_files(spark, sf).filter(~C.is_binary(F.col("content")))
    entries = M.create_manifest(
        files, max_file_mb=4194 / C.MIB, binary_as_base64=False, newline_text=True, oversized="drop"
    )
    return entries.select(
        "bundle_id", "path", C.text_checksum(F.col("content")).alias("content_sum"), "eol_style"
    )


@query("manifest_stats", f"""
WITH {FILES} SELECT bundle_id, count(*) AS file_count, count(*) FILTER (is_binary) AS binary_count,
count(*) FILTER (NOT is_binary) AS text_count, CAST(sum(length) AS BIGINT) AS total_size_bytes FROM sniffed GROUP BY 1""")
def manifest_stats(spark, sf):
    files = I.files(spark, sf).select(
        "bundle_id", C.is_binary(F.col("content")).alias("is_binary"),
        F.col("length").alias("file_size_bytes"),
    )
    return M.manifest_stats(files)


@query("manifest_metadata", f"""
WITH {FILES} SELECT bundle_id, '2.1' AS version, CAST(count(*) AS VARCHAR) AS file_count, '/data' AS source_path,
'2024-01-01 00:00:00' AS created FROM files GROUP BY 1""")
def manifest_metadata(spark, sf):
    meta = M.manifest_metadata(I.files(spark, sf), "/data", F.lit("2024-01-01 00:00:00"))
    m = F.col("metadata")
    return meta.select(
        "bundle_id", "version", m["file_count"].alias("file_count"),
        m["source_path"].alias("source_path"), m["created"].alias("created"),
    )


@query("manifest_listing", """
SELECT bundle_id, entry_idx, path, CASE WHEN n > 0 THEN format('{:,}', n) ELSE '?' END AS size, 'utf-8' AS encoding, 'LF' AS eol_style,
'' AS binary_mark FROM (SELECT CAST(conv_id AS VARCHAR) AS bundle_id, turn AS entry_idx, role || '/' || turn AS path,
CASE WHEN turn % 4 = 3 THEN 0 ELSE octet_length(encode(text)) END AS n FROM conversations)""")
def manifest_listing(spark, sf):
    c = I.load(spark, sf, "conversations")
    return M.listing(c.select(
        F.col("conv_id").cast("string").alias("bundle_id"), F.col("turn").alias("entry_idx"),
        F.expr("role || '/' || CAST(turn AS STRING)").alias("path"), F.lit("utf-8").alias("encoding"),
        F.lit("LF").alias("eol_style"), F.lit(False).alias("is_binary"),
        F.expr("CASE WHEN turn % 4 = 3 THEN 0 ELSE octet_length(text) END").alias("file_size_bytes"),
    ))


@query("duplicate_paths", f"""
WITH {FILES} SELECT bundle_id, path, count(*) AS copies FROM (
SELECT bundle_id, regexp_replace(path, '[^/]*$', '') || (doc_id % 9) AS path FROM files) GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_paths(spark, sf):
    folded = F.concat(F.regexp_replace("path", r"[^/]*$", ""), (F.regexp_extract("path", r"doc_(\d+)", 1).cast("bigint") % 9).cast("string"))
    return M.duplicate_paths(I.files(spark, sf).select("bundle_id", folded.alias("path")))


@query("duplicate_report", """
WITH f AS (SELECT '/data/' || source || '/n' || doc_id % 50 || '/' || CASE WHEN doc_id % 2 = 0 THEN 'a.md' ELSE 'b' || doc_id || '.md' END AS abs_path FROM documents),
u AS (SELECT DISTINCT abs_path FROM f),
r AS (SELECT abs_path, string_split(abs_path, '/')[-1] AS path FROM u)
SELECT path, count(*) AS copies, array_to_string(list_sort(list(abs_path))[1:3], ',') AS sources FROM r GROUP BY path HAVING count(*) > 1""")
def duplicate_report(spark, sf):
    files = _shared_names(spark, sf).dropDuplicates(["abs_path"])
    found = M.path_collisions(files, None)
    return found.select("path", "copies", F.array_join("sources", ",").alias("sources"))


def _shared_names(spark, sf):
    return I.load(spark, sf, "documents").select(F.expr(
        "'/data/' || source || '/n' || CAST(doc_id % 50 AS STRING) || '/' || "
        "CASE WHEN doc_id % 2 = 0 THEN 'a.md' ELSE 'b' || CAST(doc_id AS STRING) || '.md' END"
    ).alias("abs_path"))


@query("collision_summary", """
WITH f AS (SELECT '/data/' || source || '/n' || doc_id % 50 || '/' || CASE WHEN doc_id % 2 = 0 THEN 'a.md' ELSE 'b' || doc_id || '.md' END AS abs_path,
CASE WHEN doc_id % 2 = 0 THEN 'a.md' ELSE 'b' || doc_id || '.md' END AS name FROM documents),
r AS (SELECT 'source' AS base, CASE WHEN abs_path LIKE '/data/src1/%' THEN substr(abs_path, 12) ELSE name END AS path, NOT abs_path LIKE '/data/src1/%' AS out FROM f
UNION ALL SELECT 'parent', substr(abs_path, 7), false FROM f UNION ALL SELECT 'name', name, false FROM f),
g AS (SELECT base, path, count(*) AS n, count(*) FILTER (out) AS o FROM r GROUP BY 1, 2)
SELECT base, CAST(sum(n) AS BIGINT) AS total, count(*) AS unique_paths, count(*) FILTER (n > 1) AS duplicates, CAST(sum(o) AS BIGINT) AS outside FROM g GROUP BY 1""")
def collision_summary(spark, sf):
    return M.collision_summary(
        _shared_names(spark, sf), {"source": "/data/src1", "parent": "/data", "name": None}
    )


@query("files_outside", f"WITH {FILES} SELECT abs_path FROM files WHERE bundle_id NOT IN ('src1')")
def files_outside(spark, sf):
    return M.files_outside(I.files(spark, sf).select("abs_path"), "/data/src1")


@query("first_files", f"WITH {FILES} SELECT abs_path FROM files ORDER BY string_split(abs_path, '/') LIMIT 10")
def first_files(spark, sf):
    return M.first_files(I.files(spark, sf).select("abs_path"), 10)


@query("entry_lookup", """
SELECT CAST(conv_id AS VARCHAR) AS bundle_id, turn AS entry_idx, 'user/turn_0.py' AS path FROM conversations WHERE role = 'user' AND turn = 0""")
def entry_lookup(spark, sf):
    return M.get_entry(I.turn_entries(spark, sf), "user\\turn_0.py").select(
        "bundle_id", "entry_idx", "path"
    )


def _added(spark, sf):
    e = I.turn_entries(spark, sf)
    new = e.filter("entry_idx < 3").withColumn(
        "path", F.when(F.col("entry_idx") == 0, F.col("path")).otherwise(F.lit("new\\file.md"))
    )
    return M.add_entries(e, new)


_BASE = """c AS (SELECT CAST(conv_id AS VARCHAR) AS bundle_id, turn,
role || '/turn_' || turn || CASE turn % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.sh' ELSE '' END AS path FROM conversations),
m AS (SELECT bundle_id, max(turn) + 1 AS base FROM c GROUP BY 1)"""


@query("manifest_add", f"""
WITH {_BASE} SELECT bundle_id, turn AS entry_idx, path FROM c UNION ALL
SELECT bundle_id, base, 'new/file.md' FROM m
WHERE EXISTS (SELECT 1 FROM c c3 WHERE c3.bundle_id = m.bundle_id AND turn BETWEEN 1 AND 2)""")
def manifest_add(spark, sf):
    return _added(spark, sf)[0].select("bundle_id", "entry_idx", "path")


@query("manifest_add_rejected", f"""
WITH {_BASE} SELECT bundle_id, path, 'Entry with path ''' || path || ''' already exists' AS problem FROM (
SELECT bundle_id, path FROM c WHERE turn = 0 UNION ALL
SELECT bundle_id, 'new/file.md' FROM c WHERE turn = 2
AND EXISTS (SELECT 1 FROM c c2 WHERE c2.bundle_id = c.bundle_id AND c2.turn = 1))""")
def manifest_add_rejected(spark, sf):
    return _added(spark, sf)[1]


@query("manifest_remove", f"""
WITH {_BASE} SELECT bundle_id, path, true AS kept, false AS removed FROM c WHERE turn % 2 = 1
UNION ALL SELECT bundle_id, path, false, true FROM c WHERE turn % 2 = 0
UNION ALL SELECT DISTINCT bundle_id, 'missing', false, false FROM c""")
def manifest_remove(spark, sf):
    e = I.turn_entries(spark, sf).select("bundle_id", "entry_idx", "path")
    asked = e.filter("entry_idx % 2 = 0").select("bundle_id", F.translate("path", "/", "\\").alias("path")).union(
        e.select("bundle_id", F.lit("missing"))
    )
    kept, outcome = M.remove_entries(e, asked)
    return kept.select("bundle_id", "path", F.lit(True).alias("kept"), F.lit(False).alias("removed")).union(
        outcome.select("bundle_id", "path", F.lit(False), "removed")
    )


def _doubtful(spark, sf):
    return I.load(spark, sf, "documents").select(
        F.col("source").alias("bundle_id"), F.col("doc_id").alias("entry_idx"),
        F.expr("CASE WHEN doc_id % 19 = 0 THEN '' ELSE 'd' || chr(92) || CAST(doc_id AS STRING) END").alias("path"),
        (F.col("doc_id") % 5 == 0).alias("is_binary"),
        F.expr("CASE doc_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'lf' WHEN 2 THEN 'MIXED' ELSE 'LF' END").alias("eol_style"),
        F.expr("CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'abc' ELSE upper(sha2(text, 256)) END").alias("checksum"),
        F.expr("CASE WHEN doc_id % 23 = 1 THEN -doc_id ELSE n_chars END").alias("file_size_bytes"),
    )


@query("entry_checks", """
SELECT doc_id AS entry_idx, CASE WHEN doc_id % 19 = 0 THEN '' ELSE 'd/' || doc_id END AS path,
CASE doc_id % 6 WHEN 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'n/a' ELSE 'LF' END WHEN 1 THEN 'lf' WHEN 2 THEN 'MIXED' ELSE 'LF' END AS eol_style,
concat_ws('; ', CASE WHEN doc_id % 19 = 0 THEN 'path cannot be empty' END,
CASE WHEN doc_id % 6 = 1 THEN 'invalid eol_style: lf' END, CASE WHEN doc_id % 7 = 1 THEN 'invalid checksum: abc' END,
CASE WHEN doc_id % 23 = 1 THEN 'invalid file_size_bytes: -' || doc_id END) AS violations FROM documents""")
def entry_checks(spark, sf):
    return M.check_entries(_doubtful(spark, sf), "quarantine").select(
        "entry_idx", "path", "eol_style", F.array_join("violations", "; ").alias("violations")
    )


@query("entry_checks_drop", """
SELECT source AS bundle_id, count(*) AS entries FROM documents
WHERE doc_id % 19 <> 0 AND doc_id % 6 <> 1 AND doc_id % 7 <> 1 AND doc_id % 23 <> 1 GROUP BY 1""")
def entry_checks_drop(spark, sf):
    return M.check_entries(_doubtful(spark, sf), "drop").groupBy("bundle_id").agg(
        F.count("*").alias("entries")
    )


class _TextOnly(Profile):
    name = "text_only"


@query("profile_compat", """
SELECT bundle_id, 'Profile does not support binary files. Found: ' || string_agg(path, ', ' ORDER BY doc_id) AS problem FROM (
SELECT source AS bundle_id, doc_id, 'd' || chr(92) || doc_id AS path, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n
FROM documents WHERE doc_id % 5 = 0 AND doc_id % 19 <> 0) WHERE n <= 3 GROUP BY 1""")
def profile_compat(spark, sf):
    entries = _doubtful(spark, sf).filter("path <> ''")
    return M.profile_conflicts(entries, "text_only", ProfileRegistry([_TextOnly()]))
