"""Path expressions. All are lexical: no file system is consulted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STACK = "struct<stack:array<string>,escaped:boolean>"


def to_posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def order_key(path: Column) -> Column:
    """Sort key that orders by path component, so that ``a/x`` comes before ``a-b/x``."""
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def suffix(path: Column) -> Column:
    """Last dot and what follows; dot files and names ending in a dot have none."""
    return F.regexp_extract(base_name(path), r"(?s)\A.+(\.[^.]+)\z", 1)


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)


def is_within(path: Column, base: str) -> Column:
    root = base.rstrip("/")
    return (path == root) | F.startswith(path, F.lit(root + "/"))


def relative_to(path: Column, base: str) -> Column:
    """Path below ``base``; null for a path outside it."""
    root = base.rstrip("/")
    return F.when(
        F.startswith(path, F.lit(root + "/")),
        F.substring(path, F.lit(len(root) + 2), F.length(path)),
    ).when(path == root, F.lit("."))


def fold(path: Column) -> Column:
    """``struct(stack, escaped)``: components after ``.`` and ``..`` are applied one by one."""
    start = F.struct(
        F.array().cast("array<string>").alias("stack"), F.lit(False).alias("escaped")
    ).cast(_STACK)

    def step(acc: Column, part: Column) -> Column:
        depth = F.size(acc["stack"])
        return (
            F.when((part == "") | (part == "."), acc)
            .when(
                (part == "..") & (depth > 0),
                F.struct(
                    F.slice(acc["stack"], F.lit(1), depth - 1).alias("stack"),
                    acc["escaped"].alias("escaped"),
                ),
            )
            .when(
                part == "..",
                F.struct(acc["stack"].alias("stack"), F.lit(True).alias("escaped")),
            )
            .otherwise(
                F.struct(
                    F.concat(acc["stack"], F.array(part)).alias("stack"),
                    acc["escaped"].alias("escaped"),
                )
            )
        )

    return F.aggregate(F.split(path, "/"), start, step)


def resolve(path: Column) -> Column:
    """Extraction rule: separators normalised, leading ``/`` dropped, ``.`` and ``..`` applied.

    Most paths hold none of these, so the component fold only runs where it has work to do.
    """
    rel = F.ltrim(to_posix(path), F.lit("/"))
    plain = ~F.rlike(rel, F.lit(r"(?:\A|/)\.{0,2}(?:/|\z)"))
    return F.when(
        plain,
        F.struct(rel.alias("path"), F.lit(False).alias("escaped")),
    ).otherwise(
        F.struct(
            F.array_join(fold(rel)["stack"], "/").alias("path"),
            fold(rel)["escaped"].alias("escaped"),
        )
    )


def has_drive(path: Column) -> Column:
    return F.rlike(path, F.lit(r"\A[A-Za-z]:"))


def path_problem(path: Column, allow_absolute: bool = False) -> Column:
    """Reason a path is refused, null when it is safe."""
    posix = to_posix(path)
    absolute = F.startswith(posix, F.lit("/")) | has_drive(posix)
    when_absolute = F.lit(None).cast("string") if allow_absolute else F.lit("Absolute paths not allowed")
    return F.when(absolute, when_absolute).when(
        F.contains(posix, F.lit("..")) & fold(posix)["escaped"],
        F.lit("Path escapes base directory"),
    )


def is_safe_path(path: Column) -> Column:
    return path_problem(path).isNull()


def has_traversal(path: Column) -> Column:
    return (
        F.contains(path, F.lit(".."))
        | F.contains(path, F.lit("~"))
        | F.contains(path, F.lit("//"))
        | F.contains(path, F.lit("\\\\"))
    )


def sanitize_filename(name: Column) -> Column:
    parts = F.split(F.translate(name, '<>:"|?*', "_______"), r"[/\\]", -1)

    def clean(part: Column) -> Column:
        bare = F.btrim(part, F.lit(" ."))
        return F.when(part.isin(".", ".."), part).when(bare == "", F.lit("unnamed")).otherwise(bare)

    return F.coalesce(F.array_join(F.transform(parts, clean), "___"), F.lit("unnamed"))
