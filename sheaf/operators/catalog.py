"""Catalog of Python sources.

Python is needed for one thing, the syntax tree. The task turns each file into flat statement rows in
pre-order; scopes, sections, metrics and summaries are then worked out on those rows by Spark.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.session import deal_out


# Nodes that add one decision each.
_BRANCHES = frozenset((
    ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.ExceptHandler, ast.With, ast.AsyncWith,
    ast.Assert, ast.IfExp, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp, ast.Match,
))
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_DEFINITIONS = (*_FUNCTIONS, ast.ClassDef)
_KINDS = [kind for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST)]
_STATEMENTS = frozenset(kind for kind in _KINDS if issubclass(kind, ast.stmt))
# Nodes without a decision in or below them.
_LEAVES = frozenset(
    kind for kind in _KINDS
    if issubclass(kind, (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop))
) | {ast.Name, ast.Constant, ast.alias}
# By kind the lists of statements, or of what holds some, in the order in which they are written.
_BODIES = {
    kind: [name for name in ("body", "handlers", "cases", "orelse", "finalbody") if name in kind._fields]
    for kind in (*_STATEMENTS, ast.ExceptHandler, ast.match_case)
}

_NODE = (
    "struct<kind:string,line:int,col:int,text:string,comment:string,name:string,doc:string,"
    "names:array<struct<name:string,alias:string>>,scopes:array<struct<kind:string,name:string>>,"
    "branches:int,statements:int,pos_index:int>"
)
_ARROW_NODE = pa.struct([
    ("kind", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("text", pa.string()),
    ("comment", pa.string()), ("name", pa.string()), ("doc", pa.string()),
    ("names", pa.list_(pa.struct([("name", pa.string()), ("alias", pa.string())]))),
    ("scopes", pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string())]))),
    ("branches", pa.int32()), ("statements", pa.int32()), ("pos_index", pa.int32()),
])


def _comments(text: str) -> dict[int, str]:
    """By line, what follows the hash signs on it; none from where the source cannot be split."""
    notes: dict[int, str] = {}
    reader = tokenize.generate_tokens(io.StringIO(text).readline)
    while True:
        try:
            kind, word, (line, _), _, _ = next(reader)
        except (StopIteration, tokenize.TokenError, SyntaxError):
            return notes
        if kind == tokenize.COMMENT:
            note = word.lstrip("#").strip()
            notes[line] = f"{notes[line]} | {note}" if line in notes else note


def _names(node: ast.stmt) -> list[dict]:
    """What a statement brings in: imported names, or plain assignment targets."""
    if isinstance(node, ast.Import):
        return [{"name": a.name, "alias": a.asname} for a in node.names]
    if isinstance(node, ast.ImportFrom):
        prefix = f"{node.module}." if node.module else ""
        return [{"name": prefix + a.name, "alias": a.asname} for a in node.names]
    if isinstance(node, ast.Assign):
        single = [t for t in node.targets if isinstance(t, ast.Name)]
        return [
            {"name": n.id, "alias": None}
            for t in node.targets
            for n in ([t] if t in single else getattr(t, "elts", [])
                      if isinstance(t, (ast.Tuple, ast.List)) else [])
            if isinstance(n, ast.Name)
        ]
    return []


def _written(node: ast.AST) -> str:
    return " ".join(ast.unparse(node).split())


def _statement_text(node: ast.AST, texts: dict[ast.AST, str]) -> str:
    """A statement, exception handler or case on one line, put together from its head and the texts of
    the statements in it, so that no statement is written out again for each one around it."""
    names = _BODIES[type(node)]
    if not names:
        return _written(node)
    # A docstring is written otherwise than the same string as a statement of its own.
    first = int(type(node) in _DEFINITIONS and ast.get_docstring(node, clean=False) is not None)
    bodies = {name: getattr(node, name) for name in names}
    for name in names:
        setattr(node, name, bodies[name][:first] if name == "body" else [])
    out = [_written(node)]
    for name, nodes in bodies.items():
        setattr(node, name, nodes)
    for name, nodes in bodies.items():
        if name == "orelse" and isinstance(node, ast.If) and len(nodes) == 1 and isinstance(nodes[0], ast.If):
            out.append("el" + texts[nodes[0]])
            continue
        if nodes and name in ("orelse", "finalbody"):
            out.append("else:" if name == "orelse" else "finally:")
        for child in nodes[first:] if name == "body" else nodes:
            text = texts[child]
            out.append("except*" + text.removeprefix("except") if name == "handlers" and isinstance(node, ast.TryStar) else text)
    return " ".join(out)


def flatten(text: str, with_text: bool = True) -> list[dict]:
    """Statements of a source in pre-order, each with the totals of its own subtree and its place
    on the line, counted by column. A statement's text holds all of its body, and is what takes most time
    and room; without texts there are no comments either."""
    comments, rows = _comments(text) if with_text and "#" in text else {}, []
    texts: dict[ast.AST, str] = {}

    def visit(node: ast.AST, scopes: list[dict]) -> tuple[int, int]:
        what = type(node)
        branches = len(node.values) - 1 if what is ast.BoolOp else int(what in _BRANCHES)
        statements, row = 0, None
        if what in _STATEMENTS:
            statements = 1
            documented = isinstance(node, _DEFINITIONS)
            if documented:
                kind = "class" if isinstance(node, ast.ClassDef) else "function"
                scopes = [*scopes, {"kind": kind, "name": node.name}]
            row = {
                "kind": what.__name__, "line": node.lineno, "col": node.col_offset,
                "text": None, "comment": comments.get(node.lineno),
                "name": node.name if documented else None,
                "doc": ast.get_docstring(node) if documented else None,
                "names": _names(node), "scopes": scopes,
            }
            rows.append(row)
        for name in node._fields:
            value = getattr(node, name)
            for child in value if type(value) is list else (value,):
                if isinstance(child, ast.AST) and type(child) not in _LEAVES:
                    b, s = visit(child, scopes)
                    branches, statements = branches + b, statements + s
        if with_text and what in _BODIES:
            texts[node] = _statement_text(node, texts)
        if row is not None:
            row["branches"], row["statements"], row["text"] = branches, statements, texts.get(node)
        return branches, statements

    visit(ast.parse(text), [])
    seen: dict[int, int] = {}
    for row in sorted(rows, key=lambda r: r["col"]):
        row["pos_index"] = seen[row["line"]] = seen.get(row["line"], 0) + 1
    return rows


_NODES_PER_BATCH = 20_000


def _node_batch(paths: list, errors: list, trees: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(errors, pa.string()),
         pa.array(trees, pa.list_(_ARROW_NODE))],
        ["file", "error", "nodes"],
    )


def source_nodes(files: DataFrame, with_text: bool = True) -> DataFrame:
    """``file, error, nodes``: one row per file ``(path, text)``.

    Building trees costs far more than moving texts, so the files are dealt out evenly first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, errors, trees, held = [], [], [], 0
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                nodes, error = [], None
                try:
                    nodes = flatten(text, with_text)
                except (SyntaxError, ValueError, RecursionError) as e:
                    error = f"{'SyntaxError' if isinstance(e, SyntaxError) else type(e).__name__}: {e}"
                paths.append(path)
                errors.append(error)
                trees.append(nodes)
                held += len(nodes)
                if held > _NODES_PER_BATCH:
                    yield _node_batch(paths, errors, trees)
                    paths, errors, trees, held = [], [], [], 0
            yield _node_batch(paths, errors, trees)

    return deal_out(files.select("path", "text"), "path").mapInArrow(
        run, f"file string, error string, nodes array<{_NODE}>"
    )


def scope_label(scopes: Column) -> Column:
    """Innermost function and class of the enclosing definitions, wherever they stand."""

    def innermost(kind):
        return F.try_element_at(F.filter(scopes, lambda s: s["kind"] == kind), F.lit(-1))["name"]

    function, klass = innermost("function"), innermost("class")
    return (
        F.when(
            function.isNotNull() & klass.isNotNull(),
            F.concat(F.lit("method:"), klass, F.lit("."), function),
        )
        .when(function.isNotNull(), F.concat(F.lit("function:"), function))
        .when(klass.isNotNull(), F.concat(F.lit("class:"), klass))
        .otherwise("module")
    )


def _enclosing(n: Column) -> Column:
    """Scopes around a definition, without the one it opens."""
    return F.slice(n["scopes"], F.lit(1), F.size(n["scopes"]) - 1)


def build_catalog(files: DataFrame, with_commands: bool = True,
                  with_metrics: bool = True) -> DataFrame:
    """``files(path, text)`` to catalog rows. A file that does not parse becomes an error row. Without
    commands no statement is written out as text."""
    nodes = source_nodes(files, with_text=with_commands)

    def of(*kinds):
        return F.filter("nodes", lambda n: n["kind"].isin(*kinds))

    def named(*kinds):
        return F.flatten(F.transform(of(*kinds), lambda n: F.transform(n["names"], lambda x: F.struct(
            x["name"].alias("name"), x["alias"].alias("alias"), n["line"].alias("line"),
            scope_label(n["scopes"]).alias("scope"),
        ))))

    none = F.lit(None).cast("int")
    functions = F.transform(of("FunctionDef", "AsyncFunctionDef"), lambda n: F.struct(
        n["name"].alias("name"), n["line"].alias("line"),
        F.when(n["kind"] == "AsyncFunctionDef", F.lit("async")).otherwise("def").alias("kind"),
        scope_label(_enclosing(n)).alias("scope"), n["doc"].alias("doc"),
        (n["branches"] + 1 if with_metrics else none).alias("complexity"),
        (n["statements"] if with_metrics else none).alias("statement_count"),
    ))
    classes = F.transform(of("ClassDef"), lambda n: F.struct(
        n["name"].alias("name"), n["line"].alias("line"), n["doc"].alias("doc")
    ))
    variables = F.transform(named("Assign"), lambda v: F.struct(
        v["name"].alias("name"), v["line"].alias("line"), v["scope"].alias("scope")
    ))
    commands = F.array().cast("array<" + _COMMAND_TYPE + ">")
    if with_commands:
        commands = F.transform("nodes", lambda n: F.struct(
            scope_label(n["scopes"]).alias("scope"), n["kind"].alias("kind"),
            n["text"].alias("text"), n["line"].alias("line"), n["col"].alias("col"),
            F.translate("file", "\\", "/").alias("file"), n["comment"].alias("comment"),
            n["pos_index"].alias("pos_index"),
        ))
    failed = F.col("error").isNotNull()
    metrics = F.when(~failed, F.struct(F.struct(
        F.size("nodes").alias("statement_count"),
        F.size(of("FunctionDef", "AsyncFunctionDef")).alias("function_count"),
        F.size(of("ClassDef")).alias("class_count"),
    ).alias("file")))
    return nodes.select(
        F.translate("file", "\\", "/").alias("file"), F.lit("python").alias("language"), "error",
        named("Import", "ImportFrom").alias("imports"), classes.alias("classes"),
        functions.alias("functions"), variables.alias("variables"), commands.alias("commands"),
        (metrics if with_metrics else F.when(F.lit(False), metrics)).alias("metrics"),
    )


_COMMAND_TYPE = (
    "struct<scope:string,kind:string,text:string,line:int,col:int,file:string,comment:string,"
    "pos_index:int>"
)


def complexity_summary(catalog: DataFrame) -> DataFrame:
    """Per file: functions, mean and largest complexity."""
    return (
        catalog.select("file", F.explode("functions").alias("f"))
        .groupBy("file")
        .agg(
            F.count(F.lit(1)).alias("functions"),
            F.round(F.avg("f.complexity"), 4).alias("avg_complexity"),
            F.max("f.complexity").alias("max_complexity"),
        )
    )


def rank_on_line(commands: DataFrame, keys: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """``pos_index`` for command rows ``file, line, col, seq``, for catalogs kept in long form."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("col", "seq")
    return commands.withColumn("pos_index", F.row_number().over(w))
