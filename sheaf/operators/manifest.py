"""Files to manifest entries, and what can be asked of a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import content as C
from sheaf.functions.paths import base_name, is_within, order_key, relative_to, to_posix
from sheaf.functions.text import human_size, universal_newlines
from sheaf.operators.ordinal import running_sums, with_ordinal
from sheaf.profiles import ProfileRegistry, default_registry


def guard(bad: Column, message: Column) -> Column:
    """Filter condition that stops the job at the first bad row."""
    return F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True)


def entry_columns(path: Column, content: Column, length: Column, newline_text: bool = False,
                  strict_sniff: bool = False, binary: Column | None = None) -> dict[str, Column]:
    """Entry fields of one file's bytes."""
    binary = C.is_binary(content, strict_sniff) if binary is None else binary
    text = C.decode_replace(content)
    if newline_text:
        text = universal_newlines(text)
    return {
        "path": to_posix(path),
        "content": F.when(binary, C.to_base64(content)).otherwise(text),
        "encoding": F.when(binary, F.lit("base64")).otherwise("utf-8"),
        "is_binary": binary,
        "eol_style": F.when(binary, F.lit("n/a")).otherwise(C.eol_style(text)),
        "checksum": F.lit(None).cast("string"),
        "file_size_bytes": length.cast("bigint"),
        "content_type": F.lit(None).cast("string"),
    }


def number_files(files: DataFrame, duplicates: str = "fail") -> DataFrame:
    """``entry_idx`` by source, then path components. Best done on a listing without contents.

    A path that a bundle has twice makes a bundle that cannot be read back, so it stops the job;
    ``duplicates="keep"`` leaves the rows for :func:`duplicate_report` and its like.
    """
    order = [order_key(F.col("path"))]
    if "source_ord" in files.columns:
        order.insert(0, F.col("source_ord"))
    numbered = with_ordinal(files, ["bundle_id"], order, "entry_idx")
    if duplicates != "fail":
        return numbered
    # After the numbering: rows of a bundle are together by then, and are not shuffled once more.
    copies = F.count(F.lit(1)).over(Window.partitionBy("bundle_id", "path"))
    numbered = numbered.withColumn("__same", copies).filter(
        guard(F.col("__same") > 1, _twice(F.col("bundle_id"), F.col("path")))).drop("__same")
    return numbered.withMetadata("entry_idx", {_SINGLE: True})


#: Mark on ``entry_idx``: the paths of each bundle were found to differ. It stays with the column
#: through joins and filters.
_SINGLE = "paths_differ"


def _twice(bundle: Column, path: Column) -> Column:
    return F.concat(F.lit("Duplicate file path in bundle '"), bundle, F.lit("': "), path)


def _refuse_duplicates(files: DataFrame) -> DataFrame:
    """``files``, stopped at a path that a bundle has twice. Contents stay where they are: keys alone are
    counted, and a single row of the outcome is read by the main plan."""
    first = (
        files.groupBy("bundle_id", "path").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
        .agg(F.min(F.struct("bundle_id", "path")).alias("twice")).scalar()
    )
    return files.filter(guard(first.isNotNull(), _twice(first["bundle_id"], first["path"])))


def create_manifest(files: DataFrame, max_file_mb: float = 10.0, binary_as_base64: bool = True,
                    newline_text: bool = False, strict_sniff: bool = False,
                    oversized: str = "fail", duplicates: str = "fail") -> DataFrame:
    """``files(bundle_id, path, length, content[, entry_idx])`` to entries.

    A path that a bundle has twice stops the job, also where positions are given, unless they come
    from :func:`number_files`, which has seen to it. ``duplicates="keep"`` lets such rows pass.
    ``oversized``: ``fail`` stops at the first file over the limit, ``drop`` leaves them out; they
    are then reported by :func:`oversized_files`.
    """
    if "entry_idx" not in files.columns:
        files = number_files(files, duplicates)
    elif duplicates == "fail" and not files.schema["entry_idx"].metadata.get(_SINGLE):
        files = _refuse_duplicates(files)
    over = C.over_limit_mb(F.col("length"), max_file_mb)
    if oversized == "fail":
        files = files.filter(guard(over, C.size_message(F.col("path"), F.col("length"), max_file_mb)))
    else:
        files = files.filter(~over)
    sniffed = files.withColumn("__binary", C.is_binary(F.col("content"), strict_sniff))
    if not binary_as_base64:
        sniffed = sniffed.filter(
            guard(F.col("__binary"),
                  F.concat(F.lit("Binary file found but binary handling is disabled: "), F.col("path")))
        )
    cols = entry_columns(F.col("path"), F.col("content"), F.col("length"), newline_text,
                         binary=F.col("__binary"))
    return sniffed.select("bundle_id", "entry_idx", *[c.alias(n) for n, c in cols.items()])


def oversized_files(files: DataFrame, max_mb: float) -> DataFrame:
    return files.filter(C.over_limit_mb(F.col("length"), max_mb)).select(
        "path", C.size_mb(F.col("length")).alias("size_mb")
    )


def relative_files(files: DataFrame, base: str, outside: str = "skip") -> DataFrame:
    """``abs_path`` to ``path`` below ``base``. Files outside are skipped, or stop the job."""
    rel = relative_to(to_posix(F.col("abs_path")), base)
    if outside == "fail":
        files = files.filter(
            guard(rel.isNull(), F.concat(F.lit("File outside the base path: "), F.col("abs_path")))
        )
    return files.withColumn("path", rel).filter(F.col("path").isNotNull())


def violations(entries: DataFrame) -> DataFrame:
    """Row checks: ``violations array<string>``, with path and eol style normalised."""
    path = to_posix(F.col("path"))
    blank = F.coalesce(F.trim("eol_style"), F.lit("")) == ""
    eol = F.when(blank, F.when(F.col("is_binary"), F.lit("n/a")).otherwise("LF")).otherwise(
        F.col("eol_style")
    )
    found = F.filter(
        F.array(
            F.when(F.coalesce(path, F.lit("")) == "", F.lit("path cannot be empty")),
            F.when(~eol.isin(*C.EOL_STYLES), F.concat(F.lit("invalid eol_style: "), eol)),
            F.when(
                ~F.rlike("checksum", F.lit(r"\A[0-9a-fA-F]{64}\z")),
                F.concat(F.lit("invalid checksum: "), F.col("checksum")),
            ),
            F.when(
                F.col("file_size_bytes") < 0,
                F.concat(F.lit("invalid file_size_bytes: "), F.col("file_size_bytes").cast("string")),
            ),
        ),
        lambda m: m.isNotNull(),
    )
    return entries.withColumns({"path": path, "eol_style": eol, "violations": found})


def check_entries(entries: DataFrame, mode: str = "fail") -> DataFrame:
    """``fail`` raises at a bad row, ``drop`` leaves it out, ``quarantine`` keeps the column."""
    checked = violations(entries)
    if mode == "quarantine":
        return checked
    bad = F.size("violations") > 0
    if mode == "drop":
        return checked.filter(~bad).drop("violations")
    return checked.filter(guard(bad, F.array_join("violations", "; "))).drop("violations")


def profile_conflicts(entries: DataFrame, profile: str,
                      registry: ProfileRegistry | None = None, shown: int = 3) -> DataFrame:
    """Bundles a format without binary support cannot take, with the first binary paths."""
    p = (registry or default_registry()).get(profile)
    if p.supports("supports_binary"):
        binary = entries.filter(F.lit(False))
    else:
        binary = entries.filter("is_binary")
    first = Window.partitionBy("bundle_id").orderBy("entry_idx")
    return (
        binary.select("bundle_id", "entry_idx", "path")
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= shown)
        .groupBy("bundle_id")
        .agg(F.array_sort(F.collect_list(F.struct("entry_idx", "path"))).alias("found"))
        .select(
            "bundle_id",
            F.concat(
                F.lit("Profile does not support binary files. Found: "),
                F.array_join(F.transform("found", lambda x: x["path"]), ", "),
            ).alias("problem"),
        )
    )


def manifest_stats(entries: DataFrame) -> DataFrame:
    return entries.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.count_if("is_binary").alias("binary_count"),
        F.count_if(~F.col("is_binary")).alias("text_count"),
        F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("total_size_bytes"),
    )


def manifest_metadata(entries: DataFrame, source_path: str, created: Column | None = None) -> DataFrame:
    return entries.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("file_count")).select(
        "bundle_id",
        F.lit("2.1").alias("version"),
        F.create_map(
            F.lit("created"), (F.current_timestamp() if created is None else created).cast("string"),
            F.lit("source_path"), F.lit(source_path),
            F.lit("file_count"), F.col("file_count").cast("string"),
        ).alias("metadata"),
        "file_count",
    )


def parsed_metadata(entries: DataFrame, registry: ProfileRegistry | None = None) -> DataFrame:
    """Manifest metadata as the parser of each format writes it."""
    registry = registry or default_registry()
    meta = F.coalesce(*[
        F.when(
            F.col("profile") == p.name,
            F.create_map(*[F.lit(x) for kv in p.parsed_metadata.items() for x in kv])
            if p.parsed_metadata else F.create_map().cast("map<string,string>"),
        )
        for p in registry.all()
    ])
    return entries.groupBy("bundle_id", "profile").agg(F.count(F.lit(1)).alias("file_count")).select(
        "bundle_id", "profile", F.lit("2.1").alias("version"), meta.alias("metadata"), "file_count"
    )


def duplicate_paths(entries: DataFrame) -> DataFrame:
    return (
        entries.groupBy("bundle_id", "path")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def path_collisions(files: DataFrame, base: str | None, sources: int = 3) -> DataFrame:
    """Which relative paths several files share when ``base`` is taken as the root.

    ``base=None`` reads every file by its bare name, as do files outside the base. Per path the
    number of files and the first few of them; the rank filter trims each task's rows before the
    shuffle.
    """
    full = to_posix(F.col("abs_path"))
    rel = base_name(full)
    if base is not None:
        rel = F.coalesce(relative_to(full, base), rel)
    keyed = files.select(rel.alias("path"), "abs_path")
    counts = keyed.groupBy("path").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    first = Window.partitionBy("path").orderBy("abs_path")
    samples = (
        keyed.withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= sources)
        .groupBy("path")
        .agg(F.array_sort(F.collect_list("abs_path")).alias("sources"))
    )
    return counts.join(samples, "path")


def collision_summary(files: DataFrame, bases: dict[str, str | None]) -> DataFrame:
    """Totals per choice of base: files, distinct relative paths, shared paths, files outside."""
    full = to_posix(F.col("abs_path"))
    readings = []
    for label, base in bases.items():
        rel = base_name(full) if base is None else F.coalesce(relative_to(full, base), base_name(full))
        out = F.lit(False) if base is None else relative_to(full, base).isNull()
        readings.append(F.struct(F.lit(label).alias("base"), rel.alias("path"), out.alias("outside")))
    per_path = (
        files.select(F.explode(F.array(*readings)).alias("r"))
        .groupBy("r.base", "r.path")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("r.outside").alias("outside"))
    )
    return per_path.groupBy("base").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("unique_paths"),
        F.count_if(F.col("n") > 1).alias("duplicates"),
        F.sum("outside").alias("outside"),
    )


def files_outside(files: DataFrame, root: str) -> DataFrame:
    return files.filter(~is_within(to_posix(F.col("abs_path")), root))


def first_files(files: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of a listing, by path components."""
    return files.orderBy(order_key(F.col("abs_path"))).limit(n)


def get_entry(entries: DataFrame, path: str) -> DataFrame:
    return entries.filter(F.col("path") == path.replace("\\", "/"))


def add_entries(entries: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(manifest, rejected)``: entries whose path is taken, or given twice, are rejected.

    New entries are appended in their own order, without gaps, behind the last position of their bundle.
    """
    keys = ["bundle_id", "path"]
    new = new.withColumn("path", to_posix(F.col("path")))
    # One candidate per path from a combined minimum, joined back on a key unique to the row.
    fresh_rows = (
        new.groupBy(*keys).agg(F.min("entry_idx").alias("entry_idx"))
        .join(entries.select(*keys), keys, "left_anti")
        .withColumn("__fresh", F.lit(True))
    )
    marked = new.join(fresh_rows, [*keys, "entry_idx"], "left")
    fresh = F.col("__fresh").isNotNull()
    last = entries.groupBy("bundle_id").agg((F.max("entry_idx") + 1).alias("__base"))
    places = running_sums(
        fresh_rows.select("bundle_id", F.col("entry_idx").alias("__at")).withColumn("one", F.lit(1)), ["bundle_id"], "__at", ["one"])
    places = places.select("bundle_id", F.col("__at").alias("entry_idx"), F.col("one_before").alias("__place"))
    accepted = (
        marked.filter(fresh)
        .join(places, ["bundle_id", "entry_idx"])
        .join(last, "bundle_id", "left")
        .withColumn("entry_idx", F.coalesce("__base", F.lit(0)) + F.col("__place"))
        .select(*entries.columns)
    )
    rejected = marked.filter(~fresh).select(
        *keys,
        F.concat(F.lit("Entry with path '"), F.col("path"), F.lit("' already exists")).alias("problem"),
    )
    return entries.unionByName(accepted), rejected


def remove_entries(entries: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(manifest, outcome)``: outcome tells per requested path whether it was there."""
    keys = ["bundle_id", "path"]
    wanted = removals.select("bundle_id", to_posix(F.col("path")).alias("path")).distinct()
    present = entries.select(*keys).distinct().withColumn("__there", F.lit(True))
    outcome = wanted.join(present, keys, "left").select(
        *keys, F.coalesce("__there", F.lit(False)).alias("removed")
    )
    return entries.join(wanted, keys, "left_anti"), outcome


def verify_checksums(entries: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """``bundle_id, path, ok`` for every entry that has a recorded digest, on the row or in
    ``expected(bundle_id, path, checksum)``."""
    if expected is not None:
        entries = entries.drop("checksum").join(
            expected.select("bundle_id", "path", "checksum"), ["bundle_id", "path"]
        )
    return entries.filter(F.col("checksum").isNotNull()).select(
        "bundle_id", "path", C.verify_checksum(F.col("content"), F.col("checksum")).alias("ok")
    )


def listing(entries: DataFrame) -> DataFrame:
    """Entries as shown to a reader, in manifest order."""
    size = F.col("file_size_bytes")
    return entries.select(
        "bundle_id", "entry_idx", "path",
        F.when(size > 0, F.format_number(size, 0)).otherwise("?").alias("size"),
        "encoding", "eol_style",
        F.when(F.col("is_binary"), F.lit("✓")).otherwise("").alias("binary_mark"),
    ).orderBy("bundle_id", "entry_idx")


def preview(entries: DataFrame, bundles: DataFrame, registry: ProfileRegistry | None = None) -> DataFrame:
    """Per bundle: files, size, and characters of the formatted text.

    ``bundles`` are those of ``format_bundles``. The separator of each bundle's own format stands
    between the parts of one that comes in several, and counts.
    """
    stats = manifest_stats(entries).select("bundle_id", "file_count", "total_size_bytes")
    profiles = (registry or default_registry()).all()
    between = F.coalesce(*[F.when(F.col("profile") == p.name, len(p.separator)) for p in profiles], F.lit(0))
    chars = bundles.groupBy("bundle_id").agg(
        (F.sum(F.length("text") + between) - F.max(between)).cast("bigint").alias("char_count"))
    return stats.join(chars, "bundle_id").select(
        "bundle_id", "file_count", "total_size_bytes",
        human_size(F.col("total_size_bytes")).alias("size_label"), "char_count",
    )


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Listings in argument order, nothing removed; an overlap shows up as a duplicate path."""
    out = sources[0].withColumn("source_ord", F.lit(0))
    for i, s in enumerate(sources[1:], start=1):
        out = out.unionByName(s.withColumn("source_ord", F.lit(i)))
    return out
