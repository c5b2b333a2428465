"""Bundle formats, validation, extraction plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheaf.functions import content as C
from sheaf.operators import extract as X
from sheaf.operators import manifest as M
from sheaf.plans import formatting as W
from sheaf.plans import parsing as R
from sheaf.plans.jobs import bundle_files
from sheaf.session import checkpoint, stored
from sheaf.sources import sinks, tables
from sheaf.sources.blocks import read_slices
from workload import inputs as I
from workload.files_queries import FILES, manifest
from workload.log_queries import _work_folder
from workload.registry import CHECKS, query

_PLAIN, _FENCE = I.check_sql(I.PLAIN_BLOCK), I.check_sql(I.FENCE_BLOCK)


def _bundle_sql(block: str, prefix: str = "") -> str:
    return (
        f"SELECT '{prefix}' || CAST(conv_id AS VARCHAR) AS bundle_id, "
        f"string_agg({block}, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"
    )


# Line by line with windows: how the texts would be read one line at a time.
_LINES = (
    "split AS (SELECT bundle_id, string_split(text, chr(10)) AS l FROM bundles), "
    "numbered AS (SELECT bundle_id, unnest(l) AS line, generate_subscripts(l, 1) AS ln, len(l) AS n FROM split), "
    "lines AS (SELECT bundle_id, ln, line, line || CASE WHEN ln < n THEN chr(10) ELSE '' END AS whole FROM numbered "
    "WHERE NOT (ln = n AND line = '')), "
)
_FILE_RX = r"^\s*#\s*(?i:FILE)\s*:\s*(.+?)\s*$"
_META_RX = r"^\s*#\s*(?i:META)\s*:\s*(.+?)\s*$"
_RULE_RX = r"^\s*#\s*={10,}\s*$"
_HEAD_RX = r"^\s*<!--\s*(?i:FILE:)\s*([^;]+)\s*;\s*(.+?)\s*-->\s*$"
_FIELDS = (
    r"list_reverse(regexp_extract_all({low}, '(\w+)\s*=\s*([^;]+)', 1)) AS ks, "
    r"list_reverse(regexp_extract_all(meta, '(\w+)\s*=\s*([^;]+)', 2)) AS vs"
)


def _get(key: str) -> str:
    return f"trim(vs[list_position(ks, '{key}')])"


PLAIN_PARSE = (
    f"WITH bundles AS ({_bundle_sql(_PLAIN)}), {_LINES}"
    f"flagged AS (SELECT *, regexp_matches(line, '{_FILE_RX}') AS is_file, "
    f"regexp_matches(line, '{_META_RX}') AS is_meta, regexp_matches(line, '{_RULE_RX}') AS is_rule FROM lines), "
    "placed AS (SELECT *, sum(is_file::INT) OVER (PARTITION BY bundle_id ORDER BY ln) AS b FROM flagged), "
    f"blocks AS (SELECT bundle_id, b, max(CASE WHEN is_file THEN regexp_extract(line, '{_FILE_RX}', 1) END) AS raw, "
    f"coalesce(string_agg(CASE WHEN is_meta AND NOT is_file THEN regexp_extract(line, '{_META_RX}', 1) END, ';' ORDER BY ln), '') AS meta, "
    "coalesce(string_agg(CASE WHEN NOT is_file AND NOT is_meta AND NOT is_rule THEN whole END, '' ORDER BY ln), '') AS body "
    "FROM placed WHERE b > 0 GROUP BY 1, 2), "
    f"fields AS (SELECT *, {_FIELDS.format(low='lower(meta)')} FROM blocks WHERE raw NOT IN ('.', './', '/', '.' || chr(92))), "
    f"got AS (SELECT *, {_get('mode')} AS mode, {_get('encoding')} AS enc, {_get('eol')} AS eol, {_get('trailing')} AS trail FROM fields), "
    "parsed AS (SELECT bundle_id, b, replace(raw, chr(92), '/') AS path, "
    "lower(coalesce(nullif(enc, ''), CASE WHEN lower(mode) = 'binary' THEN 'base64' ELSE 'utf-8' END)) AS encoding, "
    "coalesce(lower(mode) = 'binary', false) OR coalesce(lower(enc) = 'base64', false) AS is_binary, "
    "nullif(eol, '') AS eol, CASE WHEN NOT regexp_matches(body, '\\S') THEN '' "
    "WHEN suffix(body, chr(10) || chr(10)) THEN substr(body, 1, length(body) - CASE WHEN lower(trail) = 'false' THEN 2 ELSE 1 END) "
    "WHEN suffix(body, chr(10)) AND lower(trail) = 'false' THEN substr(body, 1, length(body) - 1) ELSE body END AS content FROM got), "
    "bad AS (SELECT DISTINCT bundle_id FROM parsed WHERE eol NOT IN ('LF', 'CRLF', 'CR', 'MIXED', 'n/a')), "
    "kept AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, path ORDER BY b DESC) AS newest FROM parsed), "
    "entries AS (SELECT bundle_id, row_number() OVER (PARTITION BY bundle_id ORDER BY b) - 1 AS entry_idx, path, encoding, is_binary, "
    "coalesce(eol, CASE WHEN is_binary THEN 'n/a' ELSE 'LF' END) AS eol_style, content FROM kept "
    "WHERE newest = 1 AND bundle_id NOT IN (SELECT bundle_id FROM bad))"
)
FENCE_PARSE = (
    f"WITH bundles AS ({_bundle_sql(_FENCE)}), {_LINES}"
    f"flagged AS (SELECT *, regexp_matches(line, '{_HEAD_RX}') AS is_file, regexp_matches(line, '^\\s*```\\w*\\s*$') AS is_fence, "
    "regexp_matches(line, '^\\s*```\\s*$') AS is_bare FROM lines), "
    "placed AS (SELECT *, sum(is_file::INT) OVER (PARTITION BY bundle_id ORDER BY ln) AS b FROM flagged), "
    "grouped AS (SELECT *, coalesce(sum((is_fence AND NOT is_bare)::INT) OVER "
    "(PARTITION BY bundle_id, b ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM placed WHERE b > 0), "
    "stated AS (SELECT *, (CASE WHEN g > 0 THEN 1 ELSE 0 END + coalesce(sum(is_bare::INT) OVER "
    "(PARTITION BY bundle_id, b, g ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 = 1 AS inside FROM grouped), "
    f"blocks AS (SELECT bundle_id, b, trim(max(CASE WHEN is_file THEN regexp_extract(line, '{_HEAD_RX}', 1) END)) AS raw, "
    f"max(CASE WHEN is_file THEN regexp_extract(line, '{_HEAD_RX}', 2) END) AS meta, "
    "coalesce(string_agg(CASE WHEN inside AND NOT is_bare AND NOT is_file THEN whole END, '' ORDER BY ln), '') AS body FROM stated GROUP BY 1, 2), "
    f"fields AS (SELECT *, {_FIELDS.format(low='meta')} FROM blocks), "
    f"parsed AS (SELECT bundle_id, b, replace(raw, chr(92), '/') AS path, coalesce({_get('encoding')}, 'utf-8') AS encoding, "
    f"coalesce({_get('mode')} = 'binary', false) AS is_binary, coalesce({_get('eol')}, 'LF') AS eol_style, "
    "CASE WHEN suffix(body, chr(10)) THEN substr(body, 1, length(body) - 1) ELSE body END AS content FROM fields), "
    "bad AS (SELECT DISTINCT bundle_id FROM parsed WHERE eol_style NOT IN ('LF', 'CRLF', 'CR', 'MIXED', 'n/a') "
    "UNION SELECT bundle_id FROM parsed GROUP BY bundle_id, path HAVING count(*) > 1), "
    "entries AS (SELECT bundle_id, b - 1 AS entry_idx, path, encoding, is_binary, eol_style, content FROM parsed "
    "WHERE bundle_id NOT IN (SELECT bundle_id FROM bad))"
)
_SHOWN = "bundle_id, CAST(entry_idx AS BIGINT) AS entry_idx, path, encoding, is_binary, eol_style, sha256(content) AS content_sum"


def _shown(entries):
    return entries.select(
        "bundle_id", "entry_idx", "path", "encoding", "is_binary", "eol_style",
        C.text_checksum(F.col("content")).alias("content_sum"),
    )


# -- reading
@query("parse_plain", f"{PLAIN_PARSE} SELECT {_SHOWN} FROM entries")
def parse_plain(spark, sf):
    return _shown(R.parse_bundles(I.plain_bundles(spark, sf), "plain_marker"))


@query("parse_fence", f"{FENCE_PARSE} SELECT {_SHOWN} FROM entries")
def parse_fence(spark, sf):
    return _shown(R.parse_bundles(I.fence_bundles(spark, sf), "md_fence"))


@query("parse_detected", f"""
SELECT bundle_id, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS chars FROM ({PLAIN_PARSE} SELECT * FROM entries) GROUP BY 1
UNION ALL SELECT 'f' || bundle_id, count(*), CAST(sum(length(content)) AS BIGINT) FROM ({FENCE_PARSE} SELECT * FROM entries) GROUP BY 1""")
def parse_detected(spark, sf):
    return R.parse_bundles(I.mixed_bundles(spark, sf)).groupBy("bundle_id").agg(
        F.count("*").alias("files"), F.sum(F.length("content")).alias("chars")
    )


@query("parse_parts", f"{PLAIN_PARSE} SELECT bundle_id, path, encoding, is_binary, eol_style, sha256(content) AS content_sum FROM entries")
def parse_parts(spark, sf):
    """The same bundles, each cut into one part per turn, as a very large one would be."""
    parts = I.load(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("bundle_id"), F.lit("plain_marker").alias("profile"),
        F.col("turn").alias("part_no"), F.expr(I.PLAIN_BLOCK).alias("text"),
    )
    return _shown(R.parse_parts(parts)).drop("entry_idx")


def _cut(spark, sf, block, every):
    """Bundles cut behind every so many lines, wherever that is, as parts without a named format."""
    lines = F.split("text", "\n", -1)
    cut = I.load(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("bundle_id"), "turn", F.expr(block).alias("text"),
    ).groupBy("bundle_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "").alias("text"))
    numbered = cut.select("bundle_id", F.size(lines).alias("n"), F.posexplode(lines).alias("at", "line"))
    whole = F.when(F.col("at") < F.col("n") - 1, F.concat("line", F.lit("\n"))).otherwise(F.col("line"))
    return numbered.select("bundle_id", F.floor(F.col("at") / every).alias("part_no"), "at", whole.alias("line")).groupBy("bundle_id", "part_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "").alias("text"))


@query("parse_fence_lines", f"{FENCE_PARSE} SELECT bundle_id, path, encoding, is_binary, eol_style, sha256(content) AS content_sum FROM entries")
def parse_fence_lines(spark, sf):
    """Every line a part of its own: fences open in one part and close in another."""
    return _shown(R.parse_parts(_cut(spark, sf, I.FENCE_BLOCK, 1), "md_fence")).drop("entry_idx")


@query("parse_plain_lines", f"{PLAIN_PARSE} SELECT bundle_id, path, encoding, is_binary, eol_style, sha256(content) AS content_sum FROM entries")
def parse_plain_lines(spark, sf):
    """Three lines a part: metadata and contents go on in later parts."""
    return _shown(R.parse_parts(_cut(spark, sf, I.PLAIN_BLOCK, 3), "plain_marker")).drop("entry_idx")


@query("parse_slices", f"{FENCE_PARSE} SELECT bundle_id, path, encoding, is_binary, eol_style, sha256(content) AS content_sum FROM entries")
def parse_slices(spark, sf):
    """Bundles written as files and read back in slices of lines by Spark's text source."""
    root = _work_folder(spark).removeprefix("file://")
    bundles = I.fence_bundles(spark, sf).withColumns({"part_no": F.lit(0).cast("bigint"), "in_parts": F.lit(False)})
    sinks.write_bundles(spark, bundles, root)
    slices = read_slices(spark, root, slice_bytes=300).withColumn("bundle_id", F.regexp_replace("bundle_id", r"\.txt\z", ""))
    return _shown(R.parse_parts(slices, "md_fence")).drop("entry_idx")


@query("last_wins", f"""
{PLAIN_PARSE}, n AS (SELECT bundle_id, path, count(*) AS blocks, max(b) AS last_b FROM parsed GROUP BY 1, 2)
SELECT e.bundle_id, e.path, n.blocks, sha256(e.content) AS content_sum FROM entries e JOIN n USING (bundle_id, path) WHERE n.blocks > 1""")
def last_wins(spark, sf):
    """Repeated paths with the content that survives."""
    read = R.read_bundles(I.plain_bundles(spark, sf), "plain_marker").filter("problem IS NULL")
    blocks = I.load(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("bundle_id"),
        F.translate(F.expr(I.TURN_PATH), "\\", "/").alias("path"),
    ).groupBy("bundle_id", "path").agg(F.count("*").alias("blocks")).filter("blocks > 1")
    entries = read.select("bundle_id", F.explode("entries").alias("e")).select(
        "bundle_id", "e.path", C.text_checksum(F.col("e.content")).alias("content_sum")
    )
    return entries.join(blocks, ["bundle_id", "path"]).select(
        "bundle_id", "path", "blocks", "content_sum"
    )


@query("detect_profile", f"""
SELECT bundle_id, CASE WHEN CAST(bundle_id AS BIGINT) % 10 <> 9 AND regexp_matches(array_to_string(string_split(substr(text, 1, 2048), chr(10))[1:20], chr(10)), '(?m)^\\s*#\\s*(?i:FILE)\\s*:\\s*\\S')
THEN 'plain_marker' END AS profile FROM ({_bundle_sql(_PLAIN)})
UNION ALL SELECT bundle_id, CASE WHEN regexp_matches(h, '(?m)^\\s*<!--\\s*(?i:FILE:)[^;]+;.+-->\\s*$') AND regexp_matches(h, '(?m)^\\s*```\\w*\\s*$') THEN 'md_fence' END
FROM (SELECT bundle_id, array_to_string(string_split(substr(text, 1, 2048), chr(10))[1:30], chr(10)) AS h FROM ({_bundle_sql(_FENCE, 'f')}))""")
def detect_profile(spark, sf):
    return R.detect_profiles(I.mixed_bundles(spark, sf))


@query("validate_report", f"""
SELECT b.bundle_id, p.files IS NOT NULL AS valid, CASE WHEN b.conv_id % 10 <> 9 THEN 'plain_marker' END AS profile, coalesce(p.files, 0) AS file_count,
CASE WHEN b.conv_id % 10 = 9 THEN 'Profile detection failed: Could not auto-detect bundle format. Attempted: plain_marker, md_fence'
WHEN x.bundle_id IS NOT NULL THEN 'Unexpected error: Invalid eol_style: XX. Must be one of {{''LF'', ''CRLF'', ''CR'', ''MIXED'', ''n/a''}}'
WHEN p.files IS NULL THEN 'Parse error: No files found in bundle' ELSE '' END AS errors FROM
(SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS bundle_id FROM conversations) b
LEFT JOIN ({PLAIN_PARSE} SELECT bundle_id, count(*) AS files FROM entries GROUP BY 1) p USING (bundle_id)
LEFT JOIN ({PLAIN_PARSE} SELECT bundle_id FROM bad) x USING (bundle_id)""")
def validate_report(spark, sf):
    report = R.validate_bundles(I.plain_bundles(spark, sf))
    return report.select(
        "bundle_id", "valid", "profile", "file_count", F.array_join("errors", "; ").alias("errors")
    )


@query("validate_fence", f"""
SELECT b.bundle_id, p.files IS NOT NULL AS valid, coalesce(p.files, 0) AS file_count,
CASE WHEN p.files IS NOT NULL THEN '' WHEN b.conv_id % 10 = 9 THEN 'Parse error: No files found in bundle'
WHEN e.bundle_id IS NOT NULL THEN 'Unexpected error: Invalid eol_style: XX. Must be one of {{''LF'', ''CRLF'', ''CR'', ''MIXED'', ''n/a''}}'
ELSE 'Unexpected error: Duplicate file paths found: {{''same.md''}}' END AS errors FROM
(SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS bundle_id FROM conversations) b
LEFT JOIN ({FENCE_PARSE} SELECT bundle_id, count(*) AS files FROM entries GROUP BY 1) p USING (bundle_id)
LEFT JOIN ({FENCE_PARSE} SELECT DISTINCT bundle_id FROM parsed WHERE eol_style = 'XX') e USING (bundle_id)""")
def validate_fence(spark, sf):
    report = R.validate_bundles(I.fence_bundles(spark, sf), "md_fence")
    return report.select(
        "bundle_id", "valid", "file_count", F.array_join("errors", "; ").alias("errors")
    )


def _report(report):
    return report.select("bundle_id", "valid", "file_count", F.array_join("errors", "; ").alias("errors"))


@query("validate_parts", CHECKS["validate_fence"])
def validate_parts(spark, sf):
    """One report for each bundle in parts: repeated paths and bad entries in different parts."""
    return _report(R.validate_bundles(_cut(spark, sf, I.FENCE_BLOCK, 2).withColumn("in_parts", F.lit(True)), "md_fence"))


@query("validate_parts_detected", CHECKS["validate_report"])
def validate_parts_detected(spark, sf):
    """The same with formats found from the head of the first part, here of twenty lines."""
    report = R.validate_bundles(_cut(spark, sf, I.PLAIN_BLOCK, 20).withColumn("in_parts", F.lit(True)))
    return _report(report).join(report.select("bundle_id", "profile"), "bundle_id")


@query("validate_checksums", f"""
{PLAIN_PARSE}, c AS (SELECT bundle_id, path, entry_idx % 4 = 1 AS wrong FROM entries WHERE entry_idx % 2 = 1),
w AS (SELECT bundle_id, string_agg(path, ', ' ORDER BY path) AS paths FROM c WHERE wrong GROUP BY 1)
SELECT e.bundle_id, w.paths IS NULL AS valid, count(*) AS file_count,
coalesce('Checksum verification failed for: ' || w.paths, '') AS errors FROM entries e LEFT JOIN w USING (bundle_id) GROUP BY e.bundle_id, w.paths""")
def validate_checksums(spark, sf):
    bundles = I.plain_bundles(spark, sf)
    recorded = R.parse_bundles(bundles, "plain_marker").filter("entry_idx % 2 = 1").select(
        "bundle_id", "path",
        F.sha2(F.when(F.col("entry_idx") % 4 == 1, F.concat("content", F.lit("?"))).otherwise(F.col("content")), 256).alias("checksum"),
    )
    report = R.validate_bundles(bundles, "plain_marker", checksums=recorded)
    return report.filter("file_count > 0").select(
        "bundle_id", "valid", "file_count", F.array_join("errors", "; ").alias("errors")
    )


@query("parsed_metadata", f"""
{PLAIN_PARSE} SELECT bundle_id, 'plain_marker' AS profile, '2.1' AS version, '2.1.10' AS format_version, count(*) AS file_count FROM entries GROUP BY 1""")
def parsed_metadata(spark, sf):
    meta = M.parsed_metadata(R.parse_bundles(I.plain_bundles(spark, sf)))
    return meta.select(
        "bundle_id", "profile", "version", F.col("metadata")["format_version"].alias("format_version"),
        "file_count",
    )


# -- writing
_ENTRY_SQL = (
    "e AS (SELECT CAST(conv_id AS VARCHAR) AS bundle_id, turn, turn % 11 = 5 AS is_binary, "
    "role || '/turn_' || turn || CASE turn % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.sh' ELSE '' END AS path, "
    f"CASE WHEN turn % 11 = 5 THEN base64(encode({I.check_sql(I.TURN_BODY)})) ELSE {I.check_sql(I.TURN_BODY)} END AS content, "
    "CASE WHEN turn % 11 = 5 THEN 'base64' ELSE 'utf-8' END AS encoding, "
    "CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN 'CRLF' ELSE 'LF' END AS eol FROM conversations)"
)
_PLAIN_BLOCK = (
    "'# ' || repeat('=', 67) || chr(10) || '# FILE: ' || path || chr(10) || '# META: encoding=' || encoding || '; eol=' || "
    "CASE WHEN is_binary THEN 'n/a' WHEN eol IN ('LF', 'CRLF') THEN eol ELSE 'LF' END || '; mode=' || "
    "CASE WHEN is_binary THEN 'binary' ELSE 'text' END || chr(10) || '# ' || repeat('=', 67) || chr(10) || content || "
    "CASE WHEN suffix(content, chr(10)) OR content = '' THEN '' ELSE chr(10) END"
)
_FENCE_TEXT = (
    "'<!-- FILE: ' || path || '; encoding=' || encoding || '; eol=' || CASE WHEN eol <> '' THEN eol WHEN is_binary THEN 'n/a' ELSE 'LF' END "
    "|| '; mode=' || CASE WHEN is_binary THEN 'binary' ELSE 'text' END || ' -->' || chr(10) || '```' || "
    "CASE WHEN is_binary THEN '' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.sh' THEN 'shell' ELSE '' END || chr(10) || content || chr(10) || '```'"
)


@query("format_plain", f"""
WITH {_ENTRY_SQL} SELECT bundle_id, sha256(string_agg({_PLAIN_BLOCK}, '' ORDER BY turn)) AS text_sum FROM e GROUP BY 1""")
def format_plain(spark, sf):
    text = W.format_bundles(I.turn_entries(spark, sf), "plain_marker")
    return text.select("bundle_id", C.text_checksum(F.col("text")).alias("text_sum"))


@query("format_fence", f"""
WITH {_ENTRY_SQL} SELECT bundle_id, sha256(string_agg({_FENCE_TEXT}, chr(10) || chr(10) ORDER BY turn)) AS text_sum FROM e GROUP BY 1""")
def format_fence(spark, sf):
    text = W.format_bundles(I.turn_entries(spark, sf), "md_fence")
    return text.select("bundle_id", C.text_checksum(F.col("text")).alias("text_sum"))


@query("format_by_profile", f"""
WITH {_ENTRY_SQL} SELECT bundle_id, CASE WHEN CAST(bundle_id AS BIGINT) % 2 = 0 THEN 'plain_marker' ELSE 'md_fence' END AS profile,
CASE WHEN CAST(bundle_id AS BIGINT) % 2 = 0 THEN sha256(string_agg({_PLAIN_BLOCK}, '' ORDER BY turn))
ELSE sha256(string_agg({_FENCE_TEXT}, chr(10) || chr(10) ORDER BY turn)) END AS text_sum FROM e GROUP BY 1""")
def format_by_profile(spark, sf):
    profile = F.when(F.col("bundle_id").cast("bigint") % 2 == 0, F.lit("plain_marker")).otherwise("md_fence")
    text = W.format_bundles(I.turn_entries(spark, sf).withColumn("profile", profile))
    return text.select("bundle_id", "profile", C.text_checksum(F.col("text")).alias("text_sum"))


@query("format_parts", f"""
WITH {_ENTRY_SQL} SELECT bundle_id, sha256(string_agg({_PLAIN_BLOCK}, '' ORDER BY turn)) AS text_sum FROM e GROUP BY 1""")
def format_parts(spark, sf):
    """A limit small enough that most bundles come in parts; the parts add up to the whole."""
    parts = W.format_bundles(I.turn_entries(spark, sf), "plain_marker", max_bytes=2000)
    whole = W.assemble(
        parts.select("bundle_id", F.col("part_no").alias("entry_idx"), F.col("text").alias("block")), ""
    )
    return whole.select("bundle_id", C.text_checksum(F.col("text")).alias("text_sum"))


@query("convert_parts", f"""
WITH {_ENTRY_SQL} SELECT bundle_id, turn AS entry_idx, path, sha256(content) AS content_sum FROM e""")
def convert_parts(spark, sf):
    """Written in parts in one format, and again in the other: the same contents in the same order."""
    parts = checkpoint(W.format_bundles(I.turn_entries(spark, sf), "md_fence", max_bytes=1500))
    again = checkpoint(W.format_bundles(checkpoint(R.parse_bundles(parts)), "md_fence", max_bytes=900))
    entries = R.parse_bundles(again)
    place = F.row_number().over(Window.partitionBy("bundle_id").orderBy("entry_idx")) - 1
    return entries.select("bundle_id", place.alias("entry_idx"), "path", C.text_checksum(F.col("content")).alias("content_sum"))


@query("format_diagnostics", f"""
WITH {_ENTRY_SQL} SELECT bundle_id, turn AS entry_idx, path, is_binary, encoding,
CASE WHEN is_binary THEN 'n/a' WHEN eol IN ('LF', 'CRLF') THEN eol ELSE 'LF' END AS eol_style, CAST(length(content) AS INTEGER) AS content_length,
NOT is_binary AND strpos(content, chr(10) || '# ==========') > 0 AS lossy FROM e""")
def format_diagnostics(spark, sf):
    return W.format_diagnostics(I.turn_entries(spark, sf), "plain_marker")


def _preview_sql(block: str, between: str) -> str:
    return f"""
WITH {_ENTRY_SQL}, s AS (SELECT bundle_id, count(*) AS file_count, CAST(sum(octet_length(encode(raw))) AS BIGINT) AS total_size_bytes,
sum(length(block)) + {between} AS char_count FROM (SELECT bundle_id, {block} AS block,
CASE WHEN is_binary THEN decode(from_base64(content)) ELSE content END AS raw FROM e) GROUP BY 1)
SELECT bundle_id, file_count, total_size_bytes, CASE WHEN total_size_bytes < 1024 THEN total_size_bytes || ' B'
WHEN total_size_bytes < 1048576 THEN printf('%.1f KB', total_size_bytes / 1024.0) ELSE printf('%.1f MB', total_size_bytes / 1048576.0) END AS size_label,
CAST(char_count AS BIGINT) AS char_count FROM s"""


@query("preview", _preview_sql(_PLAIN_BLOCK, "0"))
def preview(spark, sf):
    entries = I.turn_entries(spark, sf)
    return M.preview(entries, W.format_bundles(entries, "plain_marker", max_bytes=2000))


@query("preview_fence", _preview_sql(_FENCE_TEXT, "2 * (count(*) - 1)"))
def preview_fence(spark, sf):
    """In parts; blank lines stand between the blocks, and so between the parts."""
    entries = I.turn_entries(spark, sf)
    return M.preview(entries, W.format_bundles(entries, "md_fence", max_bytes=2000))


@query("convert_profile", f"""
{PLAIN_PARSE}, t AS (SELECT bundle_id, entry_idx, '<!-- FILE: ' || path || '; encoding=' || encoding || '; eol=' || eol_style || '; mode=' ||
CASE WHEN is_binary THEN 'binary' ELSE 'text' END || ' -->' || chr(10) || '```' || CASE WHEN NOT is_binary AND path LIKE '%.py' THEN 'python' ELSE '' END
|| chr(10) || content || chr(10) || '```' AS block FROM entries)
SELECT bundle_id, sha256(string_agg(block, chr(10) || chr(10) ORDER BY entry_idx)) AS text_sum FROM t GROUP BY 1""")
def convert_profile(spark, sf):
    text = W.convert_bundles(I.plain_bundles(spark, sf), "md_fence", "plain_marker")
    return text.select("bundle_id", C.text_checksum(F.col("text")).alias("text_sum"))


@query("bundle_job", f"""
WITH {FILES}, k AS (SELECT * FROM entries WHERE NOT (regexp_matches(path, '(^|/)(\\.git|__pycache__|build)/') OR path LIKE '%.log')),
t AS (SELECT bundle_id, path, '<!-- FILE: ' || path || '; encoding=' || encoding || '; eol=' || eol_style || '; mode=' ||
CASE WHEN is_binary THEN 'binary' ELSE 'text' END || ' -->' || chr(10) || '```' || CASE WHEN is_binary THEN '' ELSE
coalesce(map {{'py': 'python', 'json': 'json', 'sh': 'shell', 'yaml': 'yaml'}}[lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1))], '') END
|| chr(10) || content || chr(10) || '```' AS block FROM k)
SELECT bundle_id, count(*) AS files, sha256(string_agg(block, chr(10) || chr(10) ORDER BY string_split(path, '/'))) AS text_sum FROM t GROUP BY 1""")
def bundle_job(spark, sf):
    """Files through the default deny list into one fence bundle per source."""
    from sheaf.functions.globs import DEFAULT_DENY, GlobFilter

    kept = manifest(spark, sf).filter(GlobFilter(None, DEFAULT_DENY).includes(F.col("path")))
    counts = kept.groupBy("bundle_id").agg(F.count("*").alias("files"))
    text = W.format_bundles(kept, "md_fence")
    return text.join(counts, "bundle_id").select(
        "bundle_id", "files", C.text_checksum(F.col("text")).alias("text_sum")
    )


@query("bundle_job_report", f"""
WITH {FILES}, k AS (SELECT bundle_id, path, content, eol_style, encoding, is_binary FROM entries WHERE regexp_matches(path, '(^|/)(build|fr)/.*_[0-9]*[05]\\.') AND path NOT LIKE '%.log')
SELECT bundle_id, coalesce(n, 0) AS files, coalesce(chars, 0) AS chars, CASE WHEN n IS NULL THEN 'No files left to bundle' END AS problem
FROM (SELECT DISTINCT bundle_id FROM entries) LEFT JOIN (SELECT bundle_id, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM k GROUP BY 1) USING (bundle_id)""")
def bundle_job_report(spark, sf):
    """The library's job with a filter that leaves some bundles nothing; contents read back."""
    made = checkpoint(bundle_files(I.files(spark, sf), "md_fence", ["build/*_*[05].*", "fr/*_*[05].*"], ["*.log"]))
    back = R.parse_bundles(made.filter("problem IS NULL").select("bundle_id", "text", "part_no", "in_parts"), "md_fence")
    chars = back.groupBy("bundle_id").agg(F.sum(F.length("content")).alias("chars"))
    return made.groupBy("bundle_id").agg(F.max("files").alias("files"), F.max("problem").alias("problem")).join(
        chars, "bundle_id", "left").select("bundle_id", "files", F.coalesce("chars", F.lit(0)).alias("chars"), "problem")


@query("round_trip", f"""
WITH {FILES} SELECT bundle_id, count(*) AS files, count(*) FILTER (is_binary) AS binaries,
count(*) FILTER (NOT is_binary AND eol_style = 'CR') AS cr_files, true AS exact FROM entries GROUP BY 1""")
def round_trip(spark, sf):
    """Written as fence bundles and read back: the contents are the same.

    A bundle with much of the data is many cells of a megabyte or two. Contents are told by their path,
    so those before need no position; of both sides only the checksums meet.
    """
    bundles = W.format_bundles(manifest(spark, sf), "md_fence", max_bytes=2 * C.MIB)
    digest = C.text_checksum(F.col("content"))
    back = R.parse_bundles(stored(bundles, "bundles"), "md_fence").select(
        "bundle_id", "path", "is_binary", "eol_style", digest.alias("after"))
    files = I.files(spark, sf).withColumn("entry_idx", F.lit(0))
    before = M.create_manifest(files, duplicates="keep").select("bundle_id", "path", digest.alias("before"))
    return back.join(before, ["bundle_id", "path"], "left").groupBy("bundle_id").agg(
        F.count("*").alias("files"), F.count_if("is_binary").alias("binaries"),
        F.count_if(~F.col("is_binary") & (F.col("eol_style") == "CR")).alias("cr_files"),
        F.every(F.col("after") == F.col("before")).alias("exact"),
    )


def flagship(spark, sf):
    """Documents as files, packed into one bundle per source, stored, read back and summed up."""
    entries = manifest(spark, sf)
    stored = checkpoint(W.format_bundles(entries, "plain_marker"))
    back = R.parse_bundles(stored, "plain_marker")
    return back.groupBy("bundle_id", "eol_style").agg(
        F.count("*").alias("files"), F.count_if("is_binary").alias("binaries"),
        F.sum(F.length("content")).alias("chars"),
        F.count_distinct(C.text_checksum(F.col("content"))).alias("distinct_contents"),
    )


# -- extraction
_PATHS = (
    "CASE WHEN turn % 7 = 6 THEN '../turn_' || {t} WHEN turn % 5 = 3 THEN '/user/./turn_' || {t1} || '.md' "
    "WHEN turn % 5 = 4 THEN 'user/turn_' || {t} || '_1.md' ELSE 'user/turn_' || {t} || '.md' END"
)
_S = "CAST({} AS STRING)"
_EXTRACT_PATH = _PATHS.format(t=_S.format("turn"), t1=_S.format("(turn - 1)"))


def _to_extract(spark, sf):
    """Turns as entries with aliased, escaping and undecodable ones among them."""
    c = I.load(spark, sf, "conversations")
    return tables.as_entries(
        c, F.col("conv_id"), F.col("turn"), F.expr(_EXTRACT_PATH), F.expr("text"), F.lit("LF"),
    ).withColumns({
        "is_binary": F.col("entry_idx") % 6 == 5,
        "content": F.when(F.col("entry_idx") % 6 == 5, F.lit("abc")).otherwise(F.col("content")),
        "encoding": F.when(F.col("entry_idx") % 6 == 2, F.lit("utf-8-bom")).otherwise("auto"),
    })


def _existing(spark, sf):
    return I.load(spark, sf, "conversations").filter("turn % 4 = 1").select(
        F.col("conv_id").cast("string").alias("bundle_id"),
        F.expr("'user/turn_' || CAST(turn AS STRING) || '.md'").alias("target"),
    )


_CLAIMS = (
    "c AS (SELECT CAST(conv_id AS VARCHAR) AS bundle_id, turn AS entry_idx, text, "
    "turn % 7 = 6 AS unsafe, turn % 6 = 5 AS broken, " + I.check_sql(_EXTRACT_PATH) + " AS path, "
    "CASE WHEN turn % 7 = 6 THEN '../turn_' || turn WHEN turn % 5 = 3 THEN 'user/turn_' || (turn - 1) || '.md' "
    "WHEN turn % 5 = 4 THEN 'user/turn_' || turn || '_1.md' ELSE 'user/turn_' || turn || '.md' END AS target FROM conversations), "
    "x AS (SELECT CAST(conv_id AS VARCHAR) AS bundle_id, 'user/turn_' || turn || '.md' AS target FROM conversations WHERE turn % 4 = 1), "
    "t AS (SELECT c.*, x.target IS NOT NULL OR EXISTS (SELECT 1 FROM c o WHERE o.bundle_id = c.bundle_id AND o.target = c.target "
    "AND o.entry_idx < c.entry_idx AND NOT o.unsafe AND NOT o.broken) AS taken FROM c LEFT JOIN x USING (bundle_id, target))"
)
_PAYLOAD = "sha256(CASE WHEN entry_idx % 6 = 2 THEN unhex('EFBBBF') ELSE ''::BLOB END || encode(text))"


def _actions(spark, sf, policy):
    return _shown_actions(X.plan_extraction(_to_extract(spark, sf), _existing(spark, sf), policy, add_headers=False))


def _shown_actions(actions):
    return actions.select(
        "bundle_id", "entry_idx", "path",
        F.when(F.col("error").isNull() | F.col("error").contains("decode"), F.col("target")).alias("target"),
        "status", "renamed_from", F.regexp_extract("error", r"^(\w+)", 1).alias("error"),
        F.sha2("payload", 256).alias("payload"),
    ).withColumn("error", F.nullif("error", F.lit("")))


@query("extract_plan_skip", f"""
WITH {_CLAIMS}, s AS (SELECT *, CASE WHEN unsafe THEN 'error' WHEN taken THEN 'skipped' WHEN broken THEN 'error' ELSE 'processed' END AS status FROM t)
SELECT bundle_id, entry_idx, path, CASE WHEN NOT unsafe THEN target END AS target, status, CAST(NULL AS VARCHAR) AS renamed_from,
CASE WHEN unsafe THEN 'Unsafe' WHEN status = 'error' THEN 'Binary' END AS error, CASE WHEN status = 'processed' THEN {_PAYLOAD} END AS payload FROM s""")
def extract_plan_skip(spark, sf):
    return _actions(spark, sf, "skip")


@query("extract_plan_overwrite", f"""
WITH {_CLAIMS}, s AS (SELECT *, CASE WHEN unsafe OR broken THEN 'error' ELSE 'processed' END AS status FROM t)
SELECT bundle_id, entry_idx, path, CASE WHEN NOT unsafe THEN target END AS target, status, CAST(NULL AS VARCHAR) AS renamed_from,
CASE WHEN unsafe THEN 'Unsafe' WHEN status = 'error' THEN 'Binary' END AS error, CASE WHEN status = 'processed' THEN {_PAYLOAD} END AS payload FROM s""")
def extract_plan_overwrite(spark, sf):
    return _actions(spark, sf, "overwrite")


_RENAME_SQL = f"""
WITH {_CLAIMS}, s AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, target ORDER BY entry_idx) AS nth FROM t WHERE taken AND NOT unsafe AND NOT broken)
SELECT t.bundle_id, t.entry_idx, CASE WHEN t.unsafe THEN NULL WHEN s.nth IS NOT NULL THEN regexp_replace(t.target, '\\.md$', '_' || s.nth || '.md') ELSE t.target END AS target,
CASE WHEN s.nth IS NOT NULL THEN t.target END AS renamed_from, CASE WHEN t.unsafe OR t.broken THEN 'error' ELSE 'processed' END AS status,
CASE WHEN t.unsafe THEN 'Unsafe' WHEN t.broken THEN 'Binary' END AS error FROM t LEFT JOIN s USING (bundle_id, entry_idx)"""


@query("extract_plan_rename", _RENAME_SQL)
def extract_plan_rename(spark, sf):
    return _actions(spark, sf, "rename").drop("path", "payload")


@query("extract_plan_rename_chain", """
WITH RECURSIVE c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 1 THEN 'a_1' ELSE 'a' END AS stem FROM conversations),
s AS (SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) AS turn, ['a.md'] AS taken, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS VARCHAR) AS wanted FROM c
UNION ALL SELECT conv_id, turn, list_append(taken, target), target, wanted FROM (
SELECT s.conv_id, c.turn, s.taken, c.stem || '.md' AS wanted, list_filter(list_concat([c.stem || '.md'],
list_transform(range(1, 60), lambda i: c.stem || '_' || i || '.md')), lambda x: NOT list_contains(s.taken, x))[1] AS target
FROM s JOIN c ON c.conv_id = s.conv_id AND c.turn = s.turn + 1))
SELECT CAST(conv_id AS VARCHAR) AS bundle_id, turn AS entry_idx, target, CASE WHEN target <> wanted THEN wanted END AS renamed_from FROM s WHERE turn >= 0""")
def extract_plan_rename_chain(spark, sf):
    """Names that are each other's numbered forms, so that placements depend on each other."""
    c = I.load(spark, sf, "conversations")
    entries = tables.as_entries(
        c, F.col("conv_id"), F.col("turn"),
        F.expr("CASE turn % 3 WHEN 0 THEN './a.md' WHEN 1 THEN 'a_1.md' ELSE '/a.md' END"),
        F.col("text"), F.lit("LF"),
    )
    existing = c.filter("turn = 0").select(
        F.col("conv_id").cast("string").alias("bundle_id"), F.lit("a.md").alias("target")
    )
    return X.plan_extraction(entries, existing, "rename").select(
        "bundle_id", "entry_idx", "target", "renamed_from"
    )


@query("prompt_conflicts", f"WITH {_CLAIMS} SELECT bundle_id, entry_idx, target FROM t WHERE taken AND NOT unsafe")
def prompt_conflicts(spark, sf):
    return X.conflicts(_to_extract(spark, sf), _existing(spark, sf))


@query("extract_stats", f"""
WITH {_CLAIMS}, s AS (SELECT *, CASE WHEN unsafe THEN 'error' WHEN taken THEN 'skipped' WHEN broken THEN 'error' ELSE 'processed' END AS status FROM t)
SELECT bundle_id, count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'skipped') AS skipped,
count(*) FILTER (status = 'error') AS errors FROM s GROUP BY 1""")
def extract_stats(spark, sf):
    return X.extraction_stats(
        X.plan_extraction(_to_extract(spark, sf), _existing(spark, sf), "skip", add_headers=False)
    )


@query("extract_strict_paths", f"""
WITH {_CLAIMS} SELECT bundle_id, entry_idx, CASE WHEN path LIKE '/%' THEN 'Unsafe path ''' || path || ''': Absolute paths not allowed'
WHEN unsafe THEN 'Unsafe path ''' || path || ''': Path escapes base directory' END AS error FROM t""")
def extract_strict_paths(spark, sf):
    return X.resolve_targets(_to_extract(spark, sf), "strict").select("bundle_id", "entry_idx", "error")


@query("unbundle_job", f"""
{PLAIN_PARSE} SELECT bundle_id, count(*) FILTER (NOT is_binary) AS processed, 0 AS skipped,
count(*) FILTER (is_binary) AS not_text FROM entries GROUP BY 1""")
def unbundle_job(spark, sf):
    """Bundle texts to extraction statistics; text entries land, undecodable binaries are counted."""
    entries = R.parse_bundles(I.plain_bundles(spark, sf))
    none = _existing(spark, sf).filter(F.lit(False))
    actions = X.plan_extraction(entries.filter(~F.col("is_binary")), none, "skip")
    binaries = entries.groupBy("bundle_id").agg(F.count_if("is_binary").alias("not_text"))
    stats = X.extraction_stats(actions)
    return binaries.join(stats, "bundle_id", "left").select(
        "bundle_id", F.coalesce("processed", F.lit(0)).alias("processed"),
        F.coalesce("skipped", F.lit(0)).cast("int").alias("skipped"), "not_text",
    )
