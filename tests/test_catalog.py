import ast
import random

from pyspark.sql import functions as F

from sheaf.operators import catalog as K
from sheaf.operators import diff as D
from sheaf.sources.sinks import read_catalog, write_catalog

SOURCE = '''import os as o, sys
from . import here
from pkg.mod import name as n
X = Y = 1
(a, b), c = (1, 2), 3
[p, q] = 1, 2
obj.attr = 1
class Outer:
    """Doc."""
    field = 1  # a comment
    def method(self):
        def inner(): return 1
        class Local:
            pass
        with self: pass
        return [i for i in self if i and o or n]
async def run(x):
    """Runs."""
    try:
        assert x
    except ValueError:
        pass
    match x:
        case 1: pass
    return 1 if x else 2
'''


def catalog(spark, sources):
    return K.build_catalog(spark.createDataFrame(sources, "path string, text string"))


def test_catalog(spark):
    c = catalog(spark, [("d\\a.py", SOURCE), ("bad.py", "def x(:"), ("empty.py", "")]).collect()
    rows = {r.file: r for r in c}
    assert rows["bad.py"].error.startswith("SyntaxError") and rows["bad.py"].metrics is None
    assert rows["empty.py"].commands == [] and rows["empty.py"].metrics.file.statement_count == 0
    a = rows["d/a.py"]
    assert [(i.name, i.alias) for i in a.imports] == [("os", "o"), ("sys", None), ("here", None), ("pkg.mod.name", "n")]
    assert [(k.name, k.line, k.doc) for k in a.classes] == [("Outer", 8, "Doc."), ("Local", 13, None)]
    assert [(f.name, f.kind, f.scope, f.complexity, f.statement_count) for f in a.functions] == [
        ("method", "def", "class:Outer", 5, 8), ("inner", "def", "method:Outer.method", 1, 2),
        ("run", "async", "module", 6, 8),
    ]
    assert [(v.name, v.scope) for v in a.variables] == [
        ("X", "module"), ("Y", "module"), ("c", "module"), ("p", "module"), ("q", "module"), ("field", "class:Outer")]
    on_12 = [(k.kind, k.pos_index, k.scope) for k in a.commands if k.line == 12]
    assert on_12 == [("FunctionDef", 1, "method:Outer.inner"), ("Return", 2, "method:Outer.inner")]
    assert [k.scope for k in a.commands if k.kind == "Pass" and k.line == 14] == ["method:Local.method"]
    assert [k.comment for k in a.commands if k.line == 10] == ["a comment"]
    assert a.metrics.file.function_count == 3 and a.metrics.file.class_count == 2
    assert a.metrics.file.statement_count == len(a.commands)
    summary = {r.file: r for r in K.complexity_summary(catalog(spark, [("d/a.py", SOURCE)])).collect()}
    assert summary["d/a.py"].max_complexity == 6 and summary["d/a.py"].avg_complexity == 4.0


def test_sections_are_optional(spark):
    df = spark.createDataFrame([("a.py", SOURCE)], "path string, text string")
    r = K.build_catalog(df, with_commands=False, with_metrics=False).first()
    assert r.commands == [] and r.metrics is None and r.functions[0].complexity is None


def test_catalog_file(spark, tmp_path):
    c = catalog(spark, [("a.py", SOURCE), ("bad.py", "def x(:")])
    write_catalog(c, str(tmp_path / "c"))
    back = read_catalog(spark, str(tmp_path / "c"))
    assert back.schema.simpleString() == c.schema.simpleString()
    assert sorted(r.file for r in back.collect()) == ["a.py", "bad.py"]
    (tmp_path / "one.json").write_text('[{"file": "x.py", "imports": [{"name": "os", "line": 1}]}, {"file": "y.py"}]')
    assert read_catalog(spark, str(tmp_path / "one.json"), array_file=True).count() == 2


def brute_diff(old, new):
    by_old = {(r[1], r[4], r[5]): r for r in old}
    by_new = {(r[1], r[4], r[5]): r for r in new}
    out = []
    for pos in by_old.keys() | by_new.keys():
        o, n = by_old.get(pos), by_new.get(pos)
        if o and n and o[1:4] != n[1:4]:
            out.append(("changed", o[4:6], n[4:6]))
        elif o and not n:
            out.append(("removed", o[4:6], None))
        elif n and not o:
            out.append(("added", None, n[4:6]))
    for o in old:
        same = [n for n in new if n[1:4] == o[1:4]]
        if same and all(n[4:6] != o[4:6] for n in same):
            out.append(("moved", o[4:6], same[0][4:6]))
    return sorted(out, key=str)


def test_diff_brute_force(spark):
    rng = random.Random(2)
    schema = "file string, scope string, kind string, text string, line int, pos_index int, seq int"
    for _ in range(6):
        def side():
            places = sorted(rng.sample([(ln, p) for ln in range(12) for p in (1, 2)], 15))
            rows = [("f.py", rng.choice("ab"), rng.choice("EA"), rng.choice("xyz"), ln, p) for ln, p in places]
            return rows + [rows[0][:3] + ("again",) + rows[0][4:]]
        old, new = side(), side()
        frames = [spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema) for rows in (old, new)]
        pairs = spark.createDataFrame([("f.py", "f.py")], "file_old string, file_new string")
        got = [
            (r.change_type, r.line_old is not None and (r.line_old, r.pos_old) or None, r.line_new is not None and (r.line_new, r.pos_new) or None)
            for r in D.diff_commands(*frames, pairs).collect()
        ]
        assert sorted(got, key=str) == brute_diff(old, new)


def test_compare(spark):
    changed = SOURCE.replace("X = Y", "\nX = Y").replace("field = 1", "field = 2").replace("async def run", "\nasync def ran") + "'note'\n"
    old, new = catalog(spark, [("A.py", SOURCE), ("gone.py", "x=1"), ("e.py", "")]), catalog(spark, [("a.py", changed), ("e.py", "")])
    done = D.compare_catalogs(old, new, suppress_docstrings=True)
    assert sorted((r.file_old, r.file_new) for r in done["pairs"].collect()) == [("A.py", "a.py"), ("e.py", "e.py")]
    shares = {r.file_old: r for r in done["stability"].collect()}
    assert shares["e.py"].function_stability == 1.0 and shares["A.py"].function_stability == 0.5
    kinds = {r.change_type for r in done["changes"].collect()}
    assert kinds == {"added", "removed", "changed", "moved"}
    assert not any("note" in (r.text_new or "") for r in done["changes"].filter("kind_new = 'Expr'").collect())
    mapped = D.compare_catalogs(old, new, maps=["gone.py|a.py"])
    assert [(r.file_old, r.file_new, r.key) for r in mapped["pairs"].collect()] == [("gone.py", "a.py", "gone.py | a.py")]
    assert mapped["changelog"].first().pairing_mode == "mapped"
    assert D.samples(done["changes"], 1).groupBy(*D.PAIR, "change_type").count().filter("count > 1").count() == 0
    assert D.in_report_order(done["changes"]).count() == done["changes"].count()


def test_stem_pairing(spark):
    keys = spark.createDataFrame([("a\\B.Py",), (".x",), ("d/c.tar.gz",)], "f string")
    assert [r[0] for r in keys.select(D.pairing_key(F.col("f"), "stem")).collect()] == ["b", ".x", "c.tar"]


def test_without_commands_all_else_stays(spark):
    source = "import a\nclass K:\n    'd'\n    def f(self):  # c\n        if a: x = 1; y = 2\nz, w = 1, 2\n"
    df = spark.createDataFrame([("p.py", source), ("bad.py", "def ("), ("none.py", "")], "path string, text string")
    full, light = (K.build_catalog(df, with_commands=c) for c in (True, False))
    assert full.drop("commands").orderBy("file").collect() == light.drop("commands").orderBy("file").collect()
    assert all(not n["text"] and not n["comment"] for r in K.source_nodes(df, with_text=False).collect() for n in r["nodes"])


def test_no_statement_is_written_out_for_each_one_around_it(monkeypatch):
    """Statements in statements: their texts are as of each written alone, at a cost in proportion to the source."""
    deep = "".join("  " * i + f"if a{i}: x{i} = 1\n" + "  " * i + f"while b{i}:\n" for i in range(40)) + "  " * 40 + "pass\n"
    mixed = (
        "@d\nclass A(B):\n  'd  oc\\n  \"x\"'\n  'again'\n  async def f(self):\n    async with a as b: pass\n    for i in j: x\n    else: y\n"
        "if a: b\nelif c:\n  d = ''' \n '''\nelse:\n  if e: f\n  g\n"
        "try: a\nexcept* E as e:\n  try: b\n  except (F, G): c\n  else: d\n  finally: e\nfinally: h\n"
        "match x:\n  case [1, *_] if y:\n    while z: w\n    else: v\n  case _: pass\n")
    for source in (deep, mixed):
        want = [" ".join(ast.unparse(n).split()) for n in sorted(
            (n for n in ast.walk(ast.parse(source)) if isinstance(n, ast.stmt)), key=lambda n: (n.lineno, n.col_offset))]
        got = sorted(K.flatten(source), key=lambda r: (r["line"], r["col"]))
        assert [r["text"] for r in got] == want
    written, unparse = [], ast.unparse
    monkeypatch.setattr(ast, "unparse", lambda node: written.append(unparse(node)) or written[-1])
    K.flatten(deep)
    assert sum(map(len, written)) < 2 * len("".join(deep.split()))


def test_shares_of_keys_without_sorting_them(spark):
    """Pairs may repeat, have null names or no keys; keys may be null and occur often."""
    rng = random.Random(5)
    rows = [[(rng.choice(["a", "b", None]), rng.choice(["s", None]), f"n{rng.randint(0, 30)}") for _ in range(120)] for _ in range(2)]
    old, new = (spark.createDataFrame(r, "file string, scope string, name string") for r in rows)
    named = [("a", "b"), ("a", "a"), ("a", "a"), (None, "b"), ("none", "no"), (None, None)]
    pairs = spark.createDataFrame(named, "file_old string, file_new string")
    found = D.stability(old, new, pairs, ("scope", "name"))

    def share(a, b):
        x, y = ({r[1:] for r in side if r[0] == f and f is not None} for side, f in zip(rows, (a, b)))
        return round(len(x & y) / len(x | y), 4) if x | y else 1.0

    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(str((*p, share(*p))) for p in named)
    plan = found._jdf.queryExecution().toString()
    assert plan.count("ShuffledHashJoin") >= 2 and "REPARTITION_BY_NUM" in plan
