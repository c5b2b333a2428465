"""Two catalogs compared, relationally.

A catalog here is in long form: ``commands(file, seq, scope, kind, text, line, pos_index)``,
``functions(file, scope, name)`` and ``files(file, ord)``. :func:`explode_catalog` makes them from
catalog rows. Statements are matched within a file pair by position or by signature, both far
finer keys than the file, so a huge file spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sheaf.session import checkpoint, deal_out

POSITION = ("scope", "line", "pos_index")
SIGNATURE = ("scope", "kind", "text")
PAIR = ("file_old", "file_new")
#: Tasks that the keys of one pair are dealt to.
KEY_PARTS = 16


def explode_catalog(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(commands, functions)`` in long form."""
    commands = catalog.select("file", F.posexplode("commands").alias("seq", "c")).select(
        "file", "seq", "c.scope", "c.kind", "c.text", "c.line", "c.pos_index"
    )
    functions = catalog.select("file", F.explode("functions").alias("f")).select(
        "file", "f.scope", "f.name"
    )
    return commands, functions


def pairing_key(file: Column, mode: str) -> Column:
    posix = F.translate(file, "\\", "/")
    if mode == "path":
        return F.lower(posix)
    name = F.substring_index(posix, "/", -1)
    return F.lower(F.regexp_replace(name, r"(?s)\A(.+)\.[^.]+\z", "$1"))


def pair_files(old: DataFrame, new: DataFrame, mode: str = "path") -> DataFrame:
    """``file_old, file_new, key`` for files on both sides with one key; of several files with a
    key the last in catalog order counts, combined before the shuffle."""

    def last_by_key(files: DataFrame, name: str) -> DataFrame:
        return (
            files.filter(F.coalesce("file", F.lit("")) != "")
            .groupBy(pairing_key(F.col("file"), mode).alias("key"))
            .agg(F.max_by("file", "ord").alias(name))
        )

    return last_by_key(old, "file_old").join(last_by_key(new, "file_new"), "key").select(
        *PAIR, "key"
    )


def map_files(old: DataFrame, new: DataFrame, maps: Sequence[str] | DataFrame) -> DataFrame:
    """Explicit pairs by path suffix, first match in catalog order. ``maps`` is a list of ``old|new``
    or, for many, a table ``m, old, new`` with a number for each mapping.

    The suffixes of a path that are as long as some mapping's are joined with the mappings, so a file
    meets only mappings that fit.
    """
    spark = old.sparkSession
    if not isinstance(maps, DataFrame):
        wanted = [tuple(s.strip() for s in m.split("|", 1)) for m in maps if "|" in m]
        maps = spark.createDataFrame([(i, *w) for i, w in enumerate(wanted)], "m bigint, old string, new string")

    def first_match(files: DataFrame, side: str, name: str) -> DataFrame:
        norm = lambda c: F.lower(F.translate(c, "\\", "/"))
        suffixes = maps.select("m", norm(side).alias("suffix"))
        # One row, a bounded number of lengths: paths are short.
        lengths = suffixes.agg(F.collect_set(F.length("suffix")).alias("lengths"))
        path = norm("file")
        cut = files.crossJoin(F.broadcast(lengths)).select("file", "ord", F.explode(F.transform(
            F.filter("lengths", lambda n: n <= F.length(path)),
            lambda n: F.substring(path, F.length(path) - n + 1, n))).alias("suffix"))
        return cut.join(suffixes, "suffix").groupBy("m").agg(F.min_by("file", "ord").alias(name))

    pairs = first_match(old, "old", "file_old").join(first_match(new, "new", "file_new"), "m")
    return pairs.join(maps, "m").select(*PAIR, F.concat_ws(" | ", "old", "new").alias("key"))


def without_docstrings(commands: DataFrame) -> DataFrame:
    """Bare string statements left out."""
    bare = F.btrim("text")
    quoted = F.rlike(bare, F.lit(r"(?s)\A(['\"]).*\1\z")) & (F.length(bare) >= 2)
    return commands.filter(~((F.col("kind") == "Expr") & quoted))


def _of_pairs(commands: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return commands.join(
        pairs.select(*PAIR), commands["file"] == pairs[f"file_{side}"]
    ).drop("file")


def diff_commands(old: DataFrame, new: DataFrame, pairs: DataFrame,
                  suppress_docstrings: bool = False) -> DataFrame:
    """Change rows ``file_old, file_new, scope, change_type, line_old, pos_old, line_new, pos_new,
    kind_old, kind_new, text_old, text_new``.

    The pairs, one light row per file, are read by every join and so checkpointed once.
    """
    pairs = checkpoint(pairs.select(*PAIR))
    if suppress_docstrings:
        old, new = without_docstrings(old), without_docstrings(new)
    o, n = _of_pairs(old, pairs, "old"), _of_pairs(new, pairs, "new")
    return _positional(o, n).unionByName(moved(o, n))


def _positional(o: DataFrame, n: DataFrame) -> DataFrame:
    """Added, removed and changed: one aggregation over both sides, keyed by position.

    Of several statements at one position the last counts, as the maximum of ``(seq, ...)``.
    """
    key = [*PAIR, *POSITION]

    def side(df: DataFrame, is_old: bool) -> DataFrame:
        rec = F.struct("seq", "kind", "text")
        empty = F.lit(None).cast("struct<seq:int,kind:string,text:string>")
        return df.select(*key, (rec if is_old else empty).alias("o"), (empty if is_old else rec).alias("n"))

    both = (
        side(o, True).unionByName(side(n, False))
        .groupBy(*key)
        .agg(F.max("o").alias("o"), F.max("n").alias("n"))
    )
    same = (F.col("o.kind") == F.col("n.kind")) & (F.col("o.text") == F.col("n.text"))
    change = (
        F.when(F.col("n").isNull(), F.lit("removed"))
        .when(F.col("o").isNull(), F.lit("added"))
        .when(~same, F.lit("changed"))
    )

    def when(side, value):
        return F.when(F.col(side).isNotNull(), value)

    return both.withColumn("change_type", change).filter("change_type IS NOT NULL").select(
        *PAIR, "scope", "change_type",
        when("o", F.col("line")).alias("line_old"), when("o", F.col("pos_index")).alias("pos_old"),
        when("n", F.col("line")).alias("line_new"), when("n", F.col("pos_index")).alias("pos_new"),
        F.col("o.kind").alias("kind_old"), F.col("n.kind").alias("kind_new"),
        F.col("o.text").alias("text_old"), F.col("n.text").alias("text_new"),
    )


def _signature() -> Column:
    """128 bits for a statement's pair and signature, so that joins carry no texts."""
    parts = F.struct(*PAIR, *SIGNATURE)
    return F.struct(F.xxhash64(F.lit(1), parts).alias("a"), F.xxhash64(F.lit(2), parts).alias("b"))


def moved(o: DataFrame, n: DataFrame) -> DataFrame:
    """Old statements whose signature is found on the new side, but not at their position; paired
    with its first new occurrence. Such rows are also among the added and removed ones.

    Both joins are on hashes of the signature and bring in positions only. The first occurrences
    are a combined minimum, one row per signature; where one signature makes up much of a file,
    adaptive execution splits the old side.
    """
    keyed = n.select(_signature().alias("__sig"), "seq", "line", "pos_index")
    firsts = keyed.groupBy("__sig").agg(F.min(F.struct("seq", "line", "pos_index")).alias("first"))
    stays = keyed.select("__sig", "line", "pos_index").distinct()
    loose = o.withColumn("__sig", _signature()).join(stays, ["__sig", "line", "pos_index"], "left_anti")
    return loose.join(firsts, "__sig").select(
        *PAIR, "scope", F.lit("moved").alias("change_type"),
        F.col("line").alias("line_old"), F.col("pos_index").alias("pos_old"),
        F.col("first.line").alias("line_new"), F.col("first.pos_index").alias("pos_new"),
        F.col("kind").alias("kind_old"), F.col("kind").alias("kind_new"),
        F.col("text").alias("text_old"), F.col("text").alias("text_new"),
    )


@F.pandas_udf(DoubleType())
def _four_decimals(share: pd.Series) -> pd.Series:
    """The decimal nearest to the double itself. Spark's own rounding reads the shortest decimal
    form of the double first, and so takes 1/32 for a tie."""
    return share.map(lambda v: round(float(v), 4))


def stability(old: DataFrame, new: DataFrame, pairs: DataFrame, keys: Sequence[str],
              name: str = "stability") -> DataFrame:
    """Per pair the share of distinct keys found on both sides, four decimals; 1.0 without any.

    Pairs go by number. Each one's keys are dealt to a few tasks of all there are, and the pairs, one
    light row per file, are what the joins hold: no task sorts the keys, or holds those of many others.
    """
    pairs = checkpoint(pairs.select(*PAIR, F.monotonically_increasing_id().alias("__pair")))

    def of_pairs(rows: DataFrame, side: str, bit: int) -> DataFrame:
        own = pairs.select("__pair", F.col(f"file_{side}").alias("__file")).hint("shuffle_hash")
        return rows.join(own, rows["file"] == own["__file"]).select("__pair", *keys, F.lit(bit).alias("__side"))

    both = of_pairs(old, "old", 1).unionByName(of_pairs(new, "new", 2)).withColumn(
        "__part", F.pmod(F.xxhash64(*keys), F.lit(KEY_PARTS)))
    found = deal_out(both, "__pair", "__part").groupBy("__pair", "__part", *keys).agg(F.bit_or("__side").alias("sides"))
    share = found.groupBy("__pair").agg(
        (F.count_if(F.col("sides") == 3) / F.count(F.lit(1))).alias("__share")
    )
    return pairs.join(share, "__pair", "left").select(
        *PAIR, _four_decimals(F.coalesce("__share", F.lit(1.0))).alias(name)
    )


def summarize(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*PAIR, "change_type").agg(F.count(F.lit(1)).alias("changes"))


def samples(changes: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` changes of each kind per pair, by position."""
    position = [
        F.coalesce("line_old", "line_new"), F.coalesce("pos_old", "pos_new"), F.col("line_new"),
        F.col("pos_new"),
    ]
    w = Window.partitionBy(*PAIR, "change_type").orderBy("scope", *position)
    return changes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def in_report_order(changes: DataFrame) -> DataFrame:
    line, pos = F.coalesce("line_old", "line_new"), F.coalesce("pos_old", "pos_new")
    return changes.orderBy(*PAIR, "change_type", "scope", line, pos)


def changelog(changes: DataFrame, pairing_mode: str) -> DataFrame:
    """Rows of the CSV changelog."""
    from sheaf.schemas import CHANGE_COLUMNS

    return changes.withColumns(
        {"project": F.lit(""), "pairing_mode": F.lit(pairing_mode)}
    ).select(*CHANGE_COLUMNS)


def compare_catalogs(old: DataFrame, new: DataFrame, mode: str = "path",
                     maps: Sequence[str] | DataFrame | None = None,
                     suppress_docstrings: bool = False) -> dict[str, DataFrame]:
    """The whole comparison of two catalog tables: ``pairs, stability, changes, changelog``.

    Catalog order is the column ``ord`` where a table has one (``sources.sinks.read_catalog`` gives
    the place in the file), else the file path, the order in which a scan lists the files.
    """
    def files(c):
        return c.select("file", F.col("ord" if "ord" in c.columns else "file").alias("ord"))

    mapped = isinstance(maps, DataFrame) or bool(maps)
    pairs = checkpoint(
        map_files(files(old), files(new), maps) if mapped else pair_files(files(old), files(new), mode)
    )
    (oc, of), (nc, nf) = explode_catalog(old), explode_catalog(new)
    by_function = stability(of, nf, pairs, ("scope", "name"), "function_stability")
    by_command = stability(oc, nc, pairs, SIGNATURE, "command_stability")
    changes = diff_commands(oc, nc, pairs, suppress_docstrings)
    return {
        "pairs": pairs,
        "stability": by_function.join(by_command, list(PAIR)),
        "changes": changes,
        "changelog": changelog(changes, "mapped" if mapped else mode),
    }
