"""Files, bundles, logs and catalogs derived from the given tables.

Every derivation is a SQL expression that Spark and the checking engine both read, so that the two
sides start from the same rows. ``{bytes}`` stands for the text-to-binary cast, which differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.manifest import number_files
from sheaf.plans.formatting import assemble
from sheaf.sources import tables

LF, CR, CRLF, BACKSLASH = "chr(10)", "chr(13)", "chr(13) || chr(10)", "chr(92)"

# -- documents as files
FOLDER = (
    "CASE doc_id % 11 WHEN 0 THEN '.git' WHEN 1 THEN 'src/__pycache__' WHEN 2 THEN 'src/' || lang "
    "WHEN 3 THEN 'build' WHEN 4 THEN 'src-' || lang ELSE lang END"
)
EXTENSION = (
    "CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.json' WHEN 3 THEN '.log' "
    "WHEN 4 THEN '.sh' WHEN 5 THEN '.txt' WHEN 6 THEN '' ELSE '.YAML' END"
)
FILE_PATH = f"{FOLDER} || '/doc_' || CAST(doc_id AS STRING) || {EXTENSION}"
FILE_TEXT = (
    f"CASE doc_id % 7 WHEN 0 THEN replace(text, {LF}, {CRLF}) WHEN 1 THEN replace(text, {LF}, {CR}) "
    f"WHEN 2 THEN text || {CRLF} WHEN 3 THEN replace(text, {LF}, ' ') ELSE text END"
)
FILE_BYTES = (
    f"CASE WHEN doc_id % 13 = 0 THEN unhex('89504E470D0A00') || {{bytes}}({FILE_TEXT}) "
    f"WHEN doc_id % 13 = 5 THEN unhex('FF') || {{bytes}}({FILE_TEXT}) "
    f"WHEN doc_id % 13 = 7 THEN {{bytes}}({FILE_TEXT}) || unhex('C328FF') "
    f"ELSE {{bytes}}({FILE_TEXT}) END"
)

# -- pages as paths, some of them hostile
PAGE_PATH = (
    "CASE page_id % 9 WHEN 0 THEN '/' || url WHEN 1 THEN 'C:' || chr(92) || 'page_' || CAST(page_id AS STRING) "
    "WHEN 2 THEN '../page_' || CAST(page_id AS STRING) "
    "WHEN 3 THEN 'a/../../page_' || CAST(page_id AS STRING) "
    "WHEN 4 THEN 'a/./b/../page_' || CAST(page_id AS STRING) "
    "WHEN 5 THEN '~/page_' || CAST(page_id AS STRING) "
    "WHEN 6 THEN chr(92) || chr(92) || 'host' || chr(92) || 'page_' || CAST(page_id AS STRING) "
    "WHEN 7 THEN 'dir' || chr(92) || 'page_' || CAST(page_id AS STRING) || '.html' "
    "ELSE 'site/page_' || CAST(page_id AS STRING) || '.html' END"
)

# -- conversations as bundles. k varies headers, metadata and bodies.
_K = "(conv_id * 7 + turn * 3)"
TURN_PATH = (
    f"CASE WHEN {_K} % 11 = 0 THEN './' WHEN {_K} % 5 = 1 THEN 'notes/last.md' "
    f"WHEN {_K} % 5 = 2 THEN role || {BACKSLASH} || 'turn_' || CAST(turn AS STRING) || '.py' "
    f"ELSE role || '/turn_' || CAST(turn AS STRING) || '.md' END"
)
TURN_BODY = (
    f"CASE {_K} % 6 WHEN 0 THEN text || {LF} || {LF} WHEN 1 THEN '' || {LF} || '  ' || {LF} "
    f"WHEN 2 THEN text || {LF} || '# ==============' || {LF} || 'tail' || {LF} "
    f"WHEN 3 THEN replace(text, {LF}, {CRLF}) || {CRLF} ELSE text || {LF} END"
)
_RULE = "'# ' || repeat('=', 67)"
_HEAD = (
    f"CASE {_K} % 4 WHEN 0 THEN '  #file :  ' WHEN 1 THEN '# File: ' ELSE '# FILE: ' END"
)
_EOL_VALUE = "CASE WHEN conv_id % 10 = 8 AND turn = 1 THEN 'XX' ELSE 'LF' END"
_META = (
    f"CASE {_K} % 7 WHEN 0 THEN '' WHEN 1 THEN '# META: mode=binary' || {LF} "
    f"WHEN 2 THEN '# META: Encoding = UTF-8 ; EOL=CRLF; trailing=FALSE' || {LF} "
    f"WHEN 3 THEN '# META: encoding=latin-1; encoding=utf-8; extra=1;; eol=' || {_EOL_VALUE} || {LF} "
    f"WHEN 4 THEN '#meta:eol=MIXED' || {LF} || '# META: mode=text' || {LF} "
    f"ELSE '# META: encoding=utf-8; eol=' || {_EOL_VALUE} || '; mode=text' || {LF} END"
)
PLAIN_BLOCK = (
    f"CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN 'preamble' || {LF} ELSE '' END || "
    f"CASE WHEN conv_id % 10 = 9 THEN text ELSE "
    f"{_RULE} || {LF} || {_HEAD} || {TURN_PATH} || CASE {_K} % 3 WHEN 0 THEN '  ' ELSE '' END || {LF} "
    f"|| {_META} || {_RULE} || {LF} || {TURN_BODY} END"
)
FENCE_PATH = (
    "CASE WHEN conv_id % 9 = 4 AND turn > 1 THEN 'same.md' "
    f"ELSE role || {BACKSLASH} || 'turn_' || CAST(turn AS STRING) || "
    "CASE turn % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.sh' ELSE '' END END"
)
_FENCE_META = (
    f"CASE {_K} % 5 WHEN 0 THEN ' encoding = utf-8 ; eol = CRLF ; mode = text' "
    f"WHEN 1 THEN ' encoding=base64; eol=n/a; mode=binary' WHEN 2 THEN ' x=1' "
    f"ELSE 'encoding=utf-8; eol=' || {_EOL_VALUE} || '; mode=text; mode=text' END"
)
FENCE_BLOCK = (
    f"CASE WHEN conv_id % 10 = 9 THEN text || {LF} ELSE "
    f"'<!-- FILE: ' || {FENCE_PATH} || ';' || {_FENCE_META} || ' -->' || {LF} || 'aside' || {LF} || "
    f"CASE {_K} % 3 WHEN 0 THEN '```python' WHEN 1 THEN '  ```' ELSE '```' END || {LF} || "
    f"CASE {_K} % 4 WHEN 0 THEN text || {LF} || '```js' || {LF} || 'x' || {LF} WHEN 1 THEN '' "
    f"ELSE text || {LF} END || '```' || {LF} || "
    f"CASE {_K} % 6 WHEN 0 THEN 'outside' || {LF} || '```' || {LF} || 'again' || {LF} || '``` ' || {LF} "
    f"ELSE '' END END"
)

# -- documents as statements of an old and a new catalog
STATEMENT_KIND = "CASE length(line) % 3 WHEN 0 THEN 'Expr' WHEN 1 THEN 'Assign' ELSE 'Return' END"


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def arriving(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """The table as a stream, whether it is one file or a folder of them.

    A stream takes a plain path for a folder; a pattern it lists as it finds it.
    """
    return spark.readStream.schema(load(spark, sf, table).schema).parquet(f"{sf}/[{table[0]}]{table[1:]}.parquet")


def spark_sql(expression: str) -> str:
    return expression.replace("{bytes}", "BINARY")


def check_sql(expression: str) -> str:
    return expression.replace("{bytes}", "encode").replace("AS STRING", "AS VARCHAR")


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    return d.select(
        F.col("source").alias("bundle_id"), F.expr(FILE_PATH).alias("path"),
        F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.expr(FILE_PATH)).alias("abs_path"),
        F.octet_length(F.expr(spark_sql(FILE_BYTES))).cast("bigint").alias("length"),
        F.expr(spark_sql(FILE_BYTES)).alias("content"),
    )


def numbered_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files with their place in the bundle, ranked on the listing alone."""
    listing = number_files(files(spark, sf).select("bundle_id", "path"))
    return files(spark, sf).join(listing, ["bundle_id", "path"])


def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", F.expr(PAGE_PATH).alias("path"))


def _bundles(spark: SparkSession, sf: str, block: str) -> DataFrame:
    blocks = load(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("bundle_id"), F.col("turn").alias("entry_idx"),
        F.expr(block).alias("block"),
    )
    return assemble(blocks, "").select("bundle_id", "text")


def plain_bundles(spark: SparkSession, sf: str) -> DataFrame:
    return _bundles(spark, sf, PLAIN_BLOCK)


def fence_bundles(spark: SparkSession, sf: str) -> DataFrame:
    return _bundles(spark, sf, FENCE_BLOCK)


def mixed_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Both formats in one table."""
    return plain_bundles(spark, sf).unionByName(
        fence_bundles(spark, sf).withColumn("bundle_id", F.concat(F.lit("f"), F.col("bundle_id")))
    )


def turn_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as manifest entries, one bundle each; two turns in eleven are binary."""
    c = load(spark, sf, "conversations")
    binary = F.col("turn") % 11 == 5
    base = tables.as_entries(
        c, F.col("conv_id"), F.col("turn"),
        F.expr("role || '/turn_' || CAST(turn AS STRING) || CASE turn % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.sh' ELSE '' END"),
        F.expr(TURN_BODY), F.expr("CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN 'CRLF' ELSE 'LF' END"),
    )
    return base.withColumn("is_binary", F.col("entry_idx") % 11 == 5).withColumn(
        "content",
        F.when(F.col("is_binary"), F.translate(F.base64(F.col("content").cast("binary")), "\r\n", ""))
        .otherwise(F.col("content")),
    ).withColumn("encoding", F.when(F.col("is_binary"), F.lit("base64")).otherwise("utf-8"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    return tables.as_log(
        load(spark, sf, "events"), F.col("user_id"), F.col("ts"), F.col("event_type"), F.col("props")
    )


def commands(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """Lines of each document as the statements of one file.

    The new side drops every seventh line, moves the later lines of every third document down by
    one, and edits every fifth line.
    """
    d = load(spark, sf, "documents").select(
        F.expr("source || '/' || lang || '/Doc_' || CAST(doc_id AS STRING) || '.py'").alias("file"),
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seq", "line_text"),
    ).withColumnRenamed("line_text", "line")
    kind = F.expr(STATEMENT_KIND)
    # Two statements to a line: position is (line, 1) and (line, 2) in turn.
    no = F.expr("seq DIV 2 + 1")
    pos = F.expr("seq % 2 + 1")
    scope = F.expr("CASE WHEN seq % 4 < 2 THEN 'module' ELSE 'function:f' END")
    if side == "new":
        d = d.filter("seq % 7 <> 6 AND doc_id % 10 <> 9")
        no = F.expr("seq DIV 2 + 1 + CASE WHEN doc_id % 3 = 0 AND seq > 5 THEN 1 ELSE 0 END")
        d = d.withColumn(
            "line", F.expr("CASE WHEN (doc_id + seq) % 5 = 0 THEN line || ' edited' ELSE line END")
        )
        kind = F.expr(STATEMENT_KIND)
        d = d.withColumn("file", F.expr("CASE WHEN doc_id % 4 = 0 THEN replace(file, 'Doc_', 'doc_') ELSE file END"))
    return d.select(
        "file", "seq", scope.alias("scope"), kind.alias("kind"), F.col("line").alias("text"),
        no.cast("int").alias("line"), pos.cast("int").alias("pos_index"),
    )


def catalog_files(spark: SparkSession, sf: str, side: str) -> DataFrame:
    d = load(spark, sf, "documents").select(
        "doc_id",
        F.expr("source || '/' || lang || '/Doc_' || CAST(doc_id AS STRING) || '.py'").alias("file"),
    )
    if side == "new":
        d = d.filter("doc_id % 10 <> 9").withColumn(
            "file",
            F.expr("CASE WHEN doc_id % 4 = 0 THEN replace(file, 'Doc_', 'doc_') ELSE file END"),
        )
    return d.select("file", F.col("doc_id").alias("ord"))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as small Python modules: one method per line of text."""
    words = F.expr(
        "transform(split(text, chr(10), -1), (l, i) -> concat("
        "'    def m', CAST(i AS STRING), '(self, x):  # c', CAST(i AS STRING), chr(10),"
        "'        if x and self or ', CAST(length(l) AS STRING), ': y = [v for v in x]; z = 1', chr(10),"
        "'        return ', CAST(length(l) AS STRING), chr(10)))"
    )
    text = F.concat(
        F.lit("import os, sys as system\nfrom a.b import c\n\nN = M = 1\nclass K:\n    'doc'\n"),
        F.array_join(words, ""),
        F.expr("CASE doc_id % 17 WHEN 3 THEN 'def broken(:' WHEN 9 THEN '      w = 1' ELSE '' END"),
    )
    return load(spark, sf, "documents").select(
        F.expr("source || '/doc_' || CAST(doc_id AS STRING) || '.py'").alias("path"), text.alias("text")
    )


def varied_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Python modules of one function per line, whose length decides on its branches, its
    kind, its place in a class or in another function, and its size."""
    functions = F.expr(
        "transform(split(text, chr(10), -1), (l, i) -> concat("
        "CASE WHEN length(l) % 3 = 1 THEN 'class K' WHEN length(l) % 3 = 2 THEN 'def outer' ELSE 'if N' END,"
        "CASE WHEN length(l) % 3 = 0 THEN '' ELSE CAST(i AS STRING) END,"
        "CASE WHEN length(l) % 3 = 2 THEN '():' ELSE ':' END, chr(10),"
        "CASE WHEN length(l) % 2 = 1 THEN ' async' ELSE '' END, ' def m', CAST(i AS STRING), '(x):', chr(10),"
        "repeat(concat('  while x and (x or N):', chr(10), '   x = [v for v in x]', chr(10)), length(l) % 5),"
        "CASE WHEN length(l) % 7 = 0 THEN concat('  try: pass', chr(10), '  except OSError: raise', chr(10)) ELSE '' END,"
        "'  return x', chr(10)))")
    text = F.concat(F.lit("N = 1\n"), F.array_join(functions, ""))
    return load(spark, sf, "documents").select(
        F.expr("source || '/doc_' || CAST(doc_id AS STRING) || '.py'").alias("path"), text.alias("text"))
