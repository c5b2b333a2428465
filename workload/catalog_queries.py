"""Source catalogs and their comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheaf.operators import catalog as K
from sheaf.operators import diff as D
from workload import inputs as I
from workload.registry import query

# -- two catalogs of document lines
_KIND = I.STATEMENT_KIND
_FILE = "source || '/' || lang || '/Doc_' || doc_id || '.py'"
LINES = (
    "raw AS (SELECT doc_id, string_split(text, chr(10)) AS l, " + _FILE + " AS file FROM documents), "
    "seqs AS (SELECT doc_id, file, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS seq FROM raw), "
    "old AS (SELECT doc_id, file, seq, CASE WHEN seq % 4 < 2 THEN 'module' ELSE 'function:f' END AS scope, "
    f"{_KIND} AS kind, line AS text, seq // 2 + 1 AS line_no, seq % 2 + 1 AS pos FROM seqs), "
    "edited AS (SELECT doc_id, seq, CASE WHEN doc_id % 4 = 0 THEN replace(file, 'Doc_', 'doc_') ELSE file END AS file, "
    "CASE WHEN (doc_id + seq) % 5 = 0 THEN line || ' edited' ELSE line END AS line FROM seqs WHERE seq % 7 <> 6 AND doc_id % 10 <> 9), "
    "new AS (SELECT doc_id, file, seq, CASE WHEN seq % 4 < 2 THEN 'module' ELSE 'function:f' END AS scope, "
    f"{_KIND} AS kind, line AS text, seq // 2 + 1 + CASE WHEN doc_id % 3 = 0 AND seq > 5 THEN 1 ELSE 0 END AS line_no, seq % 2 + 1 AS pos FROM edited), "
    f"names AS (SELECT doc_id, {_FILE} AS file_old, CASE WHEN doc_id % 4 = 0 THEN replace({_FILE}, 'Doc_', 'doc_') ELSE {_FILE} END AS file_new "
    "FROM documents WHERE doc_id % 10 <> 9), "
    "o AS (SELECT n.file_old, n.file_new, old.* FROM old JOIN names n USING (doc_id)), "
    "n AS (SELECT m.file_old, m.file_new, new.* FROM new JOIN names m USING (doc_id)), "
)
CHANGES = (
    LINES
    + "pos_diff AS (SELECT coalesce(o.file_old, n.file_old) AS file_old, coalesce(o.file_new, n.file_new) AS file_new, "
    "coalesce(o.scope, n.scope) AS scope, CASE WHEN n.seq IS NULL THEN 'removed' WHEN o.seq IS NULL THEN 'added' "
    "WHEN o.kind <> n.kind OR o.text <> n.text THEN 'changed' END AS change_type, "
    "o.line_no AS line_old, o.pos AS pos_old, n.line_no AS line_new, n.pos AS pos_new, o.kind AS kind_old, n.kind AS kind_new, "
    "o.text AS text_old, n.text AS text_new FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id AND o.scope = n.scope "
    "AND o.line_no = n.line_no AND o.pos = n.pos), "
    "firsts AS (SELECT doc_id, scope, kind, text, arg_min(line_no, seq) AS line_no, arg_min(pos, seq) AS pos FROM n GROUP BY 1, 2, 3, 4), "
    "moves AS (SELECT o.file_old, o.file_new, o.scope, 'moved' AS change_type, o.line_no AS line_old, o.pos AS pos_old, "
    "f.line_no AS line_new, f.pos AS pos_new, o.kind AS kind_old, o.kind AS kind_new, o.text AS text_old, o.text AS text_new "
    "FROM o JOIN firsts f USING (doc_id, scope, kind, text) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = o.doc_id AND n.scope = o.scope "
    "AND n.kind = o.kind AND n.text = o.text AND n.line_no = o.line_no AND n.pos = o.pos)), "
    "changes AS (SELECT * FROM pos_diff WHERE change_type IS NOT NULL UNION ALL SELECT * FROM moves)"
)


# A missing position is blank, as in the changelog.
_PLACES = ("line_old", "pos_old", "line_new", "pos_new")
_BLANK = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in _PLACES)


def _blank(changes):
    return changes.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _PLACES})


def _pairs(spark, sf, mode="path"):
    return D.pair_files(I.catalog_files(spark, sf, "old"), I.catalog_files(spark, sf, "new"), mode)


def _changes(spark, sf, **kw):
    return D.diff_commands(
        I.commands(spark, sf, "old"), I.commands(spark, sf, "new"), _pairs(spark, sf), **kw
    )


@query("catalog_pairing", f"""
WITH {LINES.rstrip(', ')} SELECT file_old, file_new, lower(file_old) AS key FROM names""")
def catalog_pairing(spark, sf):
    return _pairs(spark, sf)


@query("catalog_pairing_stem", """
WITH f AS (SELECT doc_id, source || '/' || lang || '/Doc_' || (doc_id % 60) || '.py' AS file, 'doc_' || (doc_id % 60) AS key FROM documents)
SELECT o.file AS file_old, n.file AS file_new, key FROM (SELECT key, arg_max(file, doc_id) AS file FROM f GROUP BY 1) o
JOIN (SELECT key, arg_max(file, doc_id) AS file FROM f WHERE doc_id % 10 <> 9 GROUP BY 1) n USING (key)""")
def catalog_pairing_stem(spark, sf):
    """Many files share a stem; the last of each side is the one paired."""
    d = I.load(spark, sf, "documents")
    old = d.select(
        F.expr("source || '/' || lang || '/Doc_' || CAST(doc_id % 60 AS STRING) || '.py'").alias("file"),
        F.col("doc_id").alias("ord"),
    )
    return D.pair_files(old, old.filter("ord % 10 <> 9"), "stem")


@query("catalog_pairing_mapped", f"""
SELECT (SELECT arg_min({_FILE}, doc_id) FROM documents WHERE lower({_FILE}) LIKE '%_1.py') AS file_old,
(SELECT arg_min({_FILE}, doc_id) FROM documents WHERE doc_id % 10 <> 9 AND lower({_FILE}) LIKE '%_12.py') AS file_new, 'Doc_1.py | DOC_12.py' AS key
UNION ALL SELECT (SELECT arg_min({_FILE}, doc_id) FROM documents WHERE lower({_FILE}) LIKE '%2.py'),
(SELECT arg_min({_FILE}, doc_id) FROM documents WHERE doc_id % 10 <> 9 AND lower({_FILE}) LIKE '%3.py'), '2.py | 3.py'""")
def catalog_pairing_mapped(spark, sf):
    old = I.catalog_files(spark, sf, "old")
    new = old.filter("ord % 10 <> 9")
    return D.map_files(old, new, ["Doc_1.py|DOC_12.py", "2.py | 3.py", "no bar", "2.py|none.py"])


_MANY = f"""f AS (SELECT doc_id, {_FILE} AS file FROM documents), maps AS (SELECT doc_id AS m, '_' || doc_id || '.PY' AS old,
lang || '/Doc_' || (doc_id * 7 + 3) % 4000 || '.py' AS new FROM documents)"""


@query("catalog_pairing_many_maps", f"""
WITH {_MANY}, o AS (SELECT m, arg_min(file, f.doc_id) AS file_old FROM maps JOIN f ON ends_with(lower(file), lower(old)) GROUP BY 1),
n AS (SELECT m, arg_min(file, f.doc_id) AS file_new FROM maps JOIN f ON ends_with(lower(file), lower(new)) AND f.doc_id % 10 <> 9 GROUP BY 1)
SELECT file_old, file_new, old || ' | ' || new AS key FROM o JOIN n USING (m) JOIN maps USING (m)""")
def catalog_pairing_many_maps(spark, sf):
    """As many mappings as documents."""
    maps = I.load(spark, sf, "documents").select(
        F.col("doc_id").alias("m"), F.expr("concat('_', doc_id, '.PY')").alias("old"),
        F.expr("concat(lang, '/Doc_', (doc_id * 7 + 3) % 4000, '.py')").alias("new"))
    old = I.catalog_files(spark, sf, "old")
    return D.map_files(old, old.filter("ord % 10 <> 9"), maps)


@query("diff_changes", f"""
WITH {CHANGES} SELECT file_old, file_new, scope, change_type, {_BLANK}, kind_old, kind_new,
md5(text_old) AS text_old, md5(text_new) AS text_new FROM changes""")
def diff_changes(spark, sf):
    return _blank(_changes(spark, sf)).withColumns(
        {"text_old": F.md5("text_old"), "text_new": F.md5("text_new")}
    )


def _side_catalog(spark, sf, side):
    """The statements of a side as a catalog: a row per file with nested commands and functions."""
    command = F.struct("seq", "scope", "kind", "text", "line", "pos_index")
    rows = I.commands(spark, sf, side).groupBy("file").agg(
        F.array_sort(F.collect_list(command)).alias("commands"),
        F.array_sort(F.collect_set(F.struct("scope", F.concat(F.lit("f"), F.length("text").cast("string")).alias("name")))).alias("functions"))
    return rows.join(I.catalog_files(spark, sf, side), "file")


@query("compare_catalogs", f"""
WITH {CHANGES}, f AS (SELECT DISTINCT doc_id, scope, length(text) AS name, 1 AS s FROM o UNION ALL SELECT DISTINCT doc_id, scope, length(text), 2 FROM n),
c AS (SELECT DISTINCT doc_id, scope, kind, text, 1 AS s FROM o UNION ALL SELECT DISTINCT doc_id, scope, kind, text, 2 FROM n),
fs AS (SELECT doc_id, printf('%.4f', count(*) FILTER (t = 3) / count(*))::DOUBLE AS function_stability FROM (SELECT doc_id, scope, name, sum(s) AS t FROM f GROUP BY 1, 2, 3) GROUP BY 1),
cs AS (SELECT doc_id, printf('%.4f', count(*) FILTER (t = 3) / count(*))::DOUBLE AS command_stability FROM (SELECT doc_id, scope, kind, text, sum(s) AS t FROM c GROUP BY 1, 2, 3, 4) GROUP BY 1),
ch AS (SELECT file_old, file_new, count(*) AS changes, count(*) FILTER (change_type = 'moved') AS moves FROM changes GROUP BY 1, 2)
SELECT file_old, file_new, function_stability, command_stability, coalesce(changes, 0) AS changes, coalesce(moves, 0) AS moves
FROM names JOIN fs USING (doc_id) JOIN cs USING (doc_id) LEFT JOIN ch USING (file_old, file_new)""")
def compare_catalogs(spark, sf):
    """The whole comparison of two catalogs, summed up per pair of files."""
    done = D.compare_catalogs(_side_catalog(spark, sf, "old"), _side_catalog(spark, sf, "new"))
    changes = done["changelog"].groupBy("file_old", "file_new").agg(
        F.count("*").alias("changes"), F.count_if(F.col("change_type") == "moved").alias("moves"))
    return done["pairs"].select("file_old", "file_new").join(done["stability"], ["file_old", "file_new"]).join(
        changes, ["file_old", "file_new"], "left").select(
        "file_old", "file_new", "function_stability", "command_stability",
        F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("moves", F.lit(0)).alias("moves"))


@query("report_order", f"""
WITH {CHANGES} SELECT file_old, change_type, scope, {_BLANK}, row_number() OVER (PARTITION BY file_old, file_new ORDER BY change_type, scope,
coalesce(line_old, line_new), coalesce(pos_old, pos_new)) AS place FROM changes""")
def report_order(spark, sf):
    """Changes in the order of the report, numbered within their pair as they come."""
    ordered = D.in_report_order(_changes(spark, sf)).withColumn("at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("file_old", "file_new").orderBy("at"))
    return _blank(ordered.withColumn("place", place)).select("file_old", "change_type", "scope", *_PLACES, "place")


@query("diff_moved", f"""
WITH {CHANGES} SELECT file_old, scope, line_old::INT AS line_old, pos_old::INT AS pos_old, line_new::INT AS line_new, pos_new::INT AS pos_new,
kind_old AS kind FROM moves""")
def diff_moved(spark, sf):
    pairs = _pairs(spark, sf)
    o = D._of_pairs(I.commands(spark, sf, "old"), pairs, "old")
    n = D._of_pairs(I.commands(spark, sf, "new"), pairs, "new")
    return D.moved(o, n).select(
        "file_old", "scope", "line_old", "pos_old", "line_new", "pos_new", F.col("kind_old").alias("kind")
    )


@query("diff_without_docstrings", """
SELECT source, count(*) AS kept FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE NOT (length(line) % 3 = 0 AND length(line) % 2 = 0) GROUP BY 1""")
def diff_without_docstrings(spark, sf):
    """Every statement of an even length is written as a quoted string; those that are bare
    expressions are docstrings."""
    lines = I.load(spark, sf, "documents").select(
        "source", F.explode(F.split("text", "\n", -1)).alias("line")
    )
    quote = F.lit("'")
    commands = lines.select(
        "source", F.expr(I.STATEMENT_KIND).alias("kind"),
        F.when(F.length("line") % 2 == 0, F.concat(quote, F.col("line"), quote)).otherwise(F.col("line")).alias("text"),
    )
    return D.without_docstrings(commands).groupBy("source").agg(F.count("*").alias("kept"))


@query("stability", f"""
WITH {LINES.rstrip(', ')}, k AS (SELECT DISTINCT doc_id, scope, kind, text, 1 AS s FROM o UNION ALL SELECT DISTINCT doc_id, scope, kind, text, 2 FROM n),
g AS (SELECT doc_id, scope, kind, text, sum(s) AS s FROM k GROUP BY 1, 2, 3, 4)
SELECT file_old, file_new, printf('%.4f', count(*) FILTER (s = 3) / count(*))::DOUBLE AS stability FROM g JOIN names USING (doc_id) GROUP BY 1, 2""")
def stability(spark, sf):
    return D.stability(
        I.commands(spark, sf, "old"), I.commands(spark, sf, "new"), _pairs(spark, sf), D.SIGNATURE
    )


@query("stability_ratios", """
SELECT 'f' || doc_id AS file_old, 'f' || doc_id AS file_new, printf('%.4f', m / n)::DOUBLE AS stability
FROM (SELECT doc_id, [1, 5, 3, 1][doc_id % 4 + 1] AS m, [32, 32, 800, 160][doc_id % 4 + 1] AS n FROM documents)""")
def stability_ratios(spark, sf):
    """Shares whose fifth decimal is a five: 1/32, 5/32, 3/800 and 1/160 of the functions remain."""
    d = I.load(spark, sf, "documents").select(
        F.concat(F.lit("f"), "doc_id").alias("file"), "lang",
        F.expr("element_at(array(1, 5, 3, 1), CAST(doc_id % 4 AS INT) + 1)").alias("m"),
        F.expr("element_at(array(32, 32, 800, 160), CAST(doc_id % 4 AS INT) + 1)").alias("n"),
    )
    names = d.select("file", "m", F.explode(F.sequence(F.lit(1), "n")).alias("i"), F.col("lang").alias("scope"))
    old = names.filter("i <= m OR i % 2 = 0").select("file", "scope", F.concat(F.lit("g"), "i").alias("name"))
    new = names.filter("i <= m OR i % 2 = 1").select("file", "scope", F.concat(F.lit("g"), "i").alias("name"))
    pairs = d.select(F.col("file").alias("file_old"), F.col("file").alias("file_new"))
    return D.stability(old, new, pairs, ("scope", "name"))


@query("change_summary", f"WITH {CHANGES} SELECT file_old, file_new, change_type, count(*) AS changes FROM changes GROUP BY 1, 2, 3")
def change_summary(spark, sf):
    return D.summarize(_changes(spark, sf))


@query("diff_samples", f"""
WITH {CHANGES}, r AS (SELECT *, row_number() OVER (PARTITION BY file_old, file_new, change_type ORDER BY scope,
coalesce(line_old, line_new), coalesce(pos_old, pos_new), line_new, pos_new) AS rank FROM changes)
SELECT file_old, change_type, rank::INT AS rank, scope, {_BLANK} FROM r WHERE rank <= 3""")
def diff_samples(spark, sf):
    return _blank(D.samples(_changes(spark, sf))).select(
        "file_old", "change_type", "rank", "scope", "line_old", "pos_old", "line_new", "pos_new"
    )


@query("changelog", f"""
WITH {CHANGES} SELECT '' AS project, 'path' AS pairing_mode, change_type, count(*) AS n, sum(coalesce(line_old, 0))::BIGINT AS old_lines FROM changes GROUP BY 3""")
def changelog(spark, sf):
    rows = D.changelog(_changes(spark, sf), "path")
    return rows.groupBy("project", "pairing_mode", "change_type").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("line_old", F.lit(0))).alias("old_lines")
    )


# -- catalogs of Python sources written from the documents
_SOURCES = (
    "src AS (SELECT doc_id, source || '/doc_' || doc_id || '.py' AS file, string_split(text, chr(10)) AS l FROM documents), "
    "good AS (SELECT *, len(l) AS n FROM src WHERE doc_id % 17 NOT IN (3, 9)), "
    "m AS (SELECT file, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM good)"
)


def _catalog(spark, sf, with_commands=False):
    """The catalog, with the statements only where a query shows them."""
    return K.build_catalog(I.sources(spark, sf), with_commands)


@query("source_catalog", f"""
WITH {_SOURCES} SELECT file, CAST(NULL AS VARCHAR) AS error, 'os,sys>system,a.b.c>' AS imports, 'K/doc' AS classes, 'N,M,module' AS variables,
CAST(n AS VARCHAR) AS function_count, '1' AS class_count, CAST(5 + 5 * n AS VARCHAR) AS statement_count FROM good
UNION ALL SELECT file, 'SyntaxError', '', '', '', NULL, NULL, NULL FROM src WHERE doc_id % 17 IN (3, 9)""")
def source_catalog(spark, sf):
    c = _catalog(spark, sf)
    shown = F.transform("imports", lambda i: F.concat(i["name"], F.when(i["name"] == "os", F.lit("")).otherwise(F.concat(F.lit(">"), F.coalesce(i["alias"], F.lit(""))))))
    variables = F.filter("variables", lambda v: v["scope"] == "module")
    return c.select(
        "file", F.regexp_extract("error", r"^(\w+)", 1).alias("error"),
        F.array_join(shown, ",").alias("imports"),
        F.array_join(F.transform("classes", lambda k: F.concat(k["name"], F.lit("/"), k["doc"])), ",").alias("classes"),
        F.array_join(F.concat(F.transform(variables, lambda v: v["name"]), F.array_distinct(F.transform(variables, lambda v: v["scope"]))), ",").alias("variables"),
        *[F.col(f"metrics.file.{n}").cast("string").alias(n)
          for n in ("function_count", "class_count", "statement_count")],
    )


@query("catalog_functions", f"""
WITH {_SOURCES} SELECT file, 'm' || i AS name, CAST(7 + 3 * i AS INTEGER) AS line, 'def' AS kind, 'class:K' AS scope,
5 AS complexity, 5 AS statement_count FROM m""")
def catalog_functions(spark, sf):
    return _catalog(spark, sf).select("file", F.explode("functions").alias("f")).select(
        "file", "f.name", "f.line", "f.kind", "f.scope", "f.complexity", "f.statement_count"
    )


@query("catalog_commands", f"""
WITH {_SOURCES}, t AS (SELECT file, i, 'x and self or ' || length(line) AS test, 'return ' || length(line) AS ret FROM m),
f AS (SELECT file, i, 'if ' || test || ': y = [v for v in x] z = 1' AS branch, ret FROM t),
d AS (SELECT file, i, 'def m' || i || '(self, x): ' || branch || ' ' || ret AS def, branch, ret FROM f),
s AS (SELECT file, i, unnest([0, 1, 1, 1, 2]) AS d, unnest(['FunctionDef', 'If', 'Assign', 'Assign', 'Return']) AS kind,
unnest([4, 8, -1, -2, 8]) AS col, unnest([1, 1, 2, 3, 1]) AS pos_index,
unnest([def, branch, 'y = [v for v in x]', 'z = 1', ret]) AS text, length(branch) AS w FROM d),
k AS (SELECT file, 'class K: \"\"\"doc\"\"\" ' || string_agg(def, ' ' ORDER BY i) AS text FROM d GROUP BY 1),
h AS (SELECT file, unnest([1, 2, 4, 6]) AS line, unnest(['Import', 'ImportFrom', 'Assign', 'Expr']) AS kind, unnest([0, 0, 0, 4]) AS col,
unnest(['import os, sys as system', 'from a.b import c', 'N = M = 1', chr(39) || 'doc' || chr(39)]) AS text, unnest(['module', 'module', 'module', 'class:K']) AS scope FROM good)
SELECT file, CAST(7 + 3 * i + d AS INTEGER) AS line, kind, pos_index, 'method:K.m' || i AS scope,
CASE WHEN kind = 'FunctionDef' THEN 'c' || i END AS comment, text,
CAST(CASE col WHEN -1 THEN w - 16 WHEN -2 THEN w + 4 ELSE col END AS INTEGER) AS col FROM s
UNION ALL SELECT file, CAST(line AS INTEGER), kind, 1, scope, NULL, text, CAST(col AS INTEGER) FROM h
UNION ALL SELECT file, 5, 'ClassDef', 1, 'class:K', NULL, text, 0 FROM k""")
def catalog_commands(spark, sf):
    """All statements, with their texts and places."""
    full = _catalog(spark, sf, with_commands=True).select("file", F.explode("commands").alias("c"))
    return full.select("file", "c.line", "c.kind", "c.pos_index", "c.scope", "c.comment", "c.text", "c.col")


@query("complexity_summary", f"""
WITH {_SOURCES} SELECT file, count(*) AS functions, 5.0::DOUBLE AS avg_complexity, 5 AS max_complexity FROM m GROUP BY 1""")
def complexity_summary(spark, sf):
    return K.complexity_summary(_catalog(spark, sf))


# A function has a branch and two operators' ends more in each loop, and a list's loop; a `try` is two branches.
_VARIED = """
t AS (SELECT source || '/doc_' || doc_id || '.py' AS file, string_split(text, chr(10)) AS l FROM documents),
u AS (SELECT file, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM t),
w AS (SELECT file, i, length(line) AS n, 2 * (n % 5) AS loops, CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END AS tries FROM u),
v AS (SELECT *, 3 + loops + 2 * tries AS height, 1 + 2 * loops + 2 * tries AS complexity, 2 + loops + 3 * tries AS statements FROM w),
p AS (SELECT *, 2 + sum(height) OVER (PARTITION BY file ORDER BY i) - height AS top FROM v),
f AS (SELECT file, 'm' || i AS name, CAST(top + 1 AS INTEGER) AS line, CASE WHEN n % 2 = 1 THEN 'async' ELSE 'def' END AS kind,
CASE n % 3 WHEN 1 THEN 'class:K' || i WHEN 2 THEN 'function:outer' || i ELSE 'module' END AS scope,
CAST(complexity AS INTEGER) AS complexity, CAST(statements AS INTEGER) AS statement_count FROM p
UNION ALL SELECT file, 'outer' || i, CAST(top AS INTEGER), 'def', 'module', CAST(complexity AS INTEGER), CAST(statements + 1 AS INTEGER)
FROM p WHERE n % 3 = 2)"""


@query("catalog_functions_varied", f"WITH {_VARIED} SELECT * FROM f")
def catalog_functions_varied(spark, sf):
    """Functions of many shapes, inside of classes, functions and conditions."""
    c = K.build_catalog(I.varied_sources(spark, sf), with_commands=False)
    return c.select("file", F.explode("functions").alias("f")).select(
        "file", "f.name", "f.line", "f.kind", "f.scope", "f.complexity", "f.statement_count")


@query("complexity_summary_varied", f"""
WITH {_VARIED} SELECT file, count(*) AS functions, round(avg(complexity), 4) AS avg_complexity, max(complexity) AS max_complexity FROM f GROUP BY 1""")
def complexity_summary_varied(spark, sf):
    return K.complexity_summary(K.build_catalog(I.varied_sources(spark, sf), with_commands=False))


@query("position_on_line", """
SELECT doc_id, seq::INT AS seq, (row_number() OVER (PARTITION BY doc_id, seq // 3 ORDER BY (seq * 7) % 3, seq))::INT AS pos_index
FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS seq FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def position_on_line(spark, sf):
    lines = I.load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seq", "t"))
    commands = lines.select(
        "doc_id", F.col("doc_id").alias("file"), "seq", F.expr("seq DIV 3").alias("line"),
        F.expr("(seq * 7) % 3").alias("col"),
    )
    return K.rank_on_line(commands).select("doc_id", "seq", "pos_index")
