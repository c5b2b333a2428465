"""Entries to bundle text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.once import once
from sheaf.operators.ordinal import running_sums
from sheaf.plans.parsing import ONE_ROW, _chooser, parse_bundles
from sheaf.profiles import Profile, ProfileRegistry, default_registry

MAX_TEXT_BYTES = 256 * 1024 * 1024
#: From this limit on, the bounds of parts are so few beside the texts that they are broadcast.
BROADCAST_FROM = 1024 * 1024
#: Positions that have their bounds in one row.
PLACES = 1024
_USED = ("path", "content", "encoding", "is_binary", "eol_style")


def format_blocks(entries: DataFrame, profile: str | None = None,
                  registry: ProfileRegistry | None = None, on_problem: str = "fail") -> DataFrame:
    """``bundle_id, profile, entry_idx, path, block, lossy, problem``, one block per entry.

    Without ``profile`` each row is written in the format its own ``profile`` column names.
    ``on_problem``: ``fail`` raises, ``drop`` leaves the entry out, ``quarantine`` keeps the row
    with its problem and no block.
    """
    registry = registry or default_registry()
    if profile is not None:
        pick = _chooser([registry.get(profile)], None)
        entries = entries.withColumn("profile", F.lit(profile))
    else:
        pick = _chooser(registry.all(), F.col("profile"))

    cols = {c: F.col(c) for c in _USED}

    def prepared(p: Profile) -> Column:
        entry = p.prepare(cols)
        return F.struct(p.problem(entry).alias("problem"), *[entry[c].alias(c) for c in _USED])

    ready = entries.select(
        "bundle_id", "profile", "entry_idx", pick(prepared).alias("e")
    ).select("bundle_id", "profile", "entry_idx", "e.*")
    block = pick(lambda p: p.block(cols))
    failed = F.col("problem").isNotNull()
    if on_problem == "fail":
        block = F.when(failed, F.raise_error(F.col("problem")).cast("string")).otherwise(block)
    elif on_problem == "drop":
        ready = ready.filter(~failed)
    else:
        block = F.when(~failed, block)
    return ready.select(
        "bundle_id", "profile", "entry_idx", "path", block.alias("block"),
        (~F.col("is_binary") & pick(lambda p: p.lossy(F.col("content")))).alias("lossy"),
        "problem",
    )


def assemble(blocks: DataFrame, separator: Column | str, max_bytes: int = MAX_TEXT_BYTES,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """``bundle_id, part_no, in_parts, text``: blocks joined in entry order.

    A bundle up to ``max_bytes`` is one row with ``part_no`` 0. A larger one is cut between blocks, by
    running sums of bytes: a new part starts where the sum passes a multiple of half the limit, and a
    block above half the limit is a part of its own. So no part exceeds the limit but a single block
    that does. Part numbers start at 0 and rise, with gaps where blocks above half the limit meet.

    Sizes are summed with a map-side combine. Only blocks of bundles over the limit get a part from
    rows without text. Under a small limit these are joined back by position, and whether they are
    broadcast is left to Spark, which has measured them by then. Under one of ``BROADCAST_FROM`` or more
    the places where parts start are broadcast, so that texts are shuffled once, into their parts; they
    are two for each limit of text at most, and one for each ``PLACES`` positions.
    """
    half = max(max_bytes // 2, 1)
    wide = max_bytes >= BROADCAST_FROM
    size = F.octet_length("block") + 2
    if wide:
        size = F.coalesce(size, F.lit(0))
    sizes = blocks.select("bundle_id", "entry_idx", size.cast("bigint").alias("bytes"))
    if wide:
        # What reads the sizes shares this shuffle: filters stay above the generator, so it is one.
        sizes = once(sizes.repartition("bundle_id", "entry_idx"), *sizes.columns)
    oversized = (
        sizes.groupBy("bundle_id")
        .agg(F.sum("bytes").alias("sum"), F.min_by("bytes", "entry_idx").alias("first"))
        .filter(F.col("sum") > max_bytes)
        .select("bundle_id", (F.col("first") > half).cast("bigint").alias("shift"))
    )
    large = F.col("bytes") > half
    running = running_sums(
        sizes.join(oversized, "bundle_id").withColumns({
            "large": large.cast("bigint"), "small": F.when(large, 0).otherwise(F.col("bytes"))}),
        ["bundle_id"], "entry_idx", ["large", "small"],
    )
    cut = running.select(
        "bundle_id", "entry_idx",
        (2 * F.col("large_before") + F.col("large") + F.floor(F.col("small_before") / F.lit(half)) - F.col("shift"))
        .cast("bigint").alias("cut_no"),
    )
    sized = _cut_by_bounds(blocks, cut) if wide else blocks.join(cut, ["bundle_id", "entry_idx"], "left")

    part = F.coalesce("cut_no", F.lit(0)).cast("bigint")
    sep = F.lit(separator) if isinstance(separator, str) else separator
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("entry_idx", "block"))), lambda x: x["block"]
    )
    return (
        sized.withColumn("part_no", part)
        .withColumn("in_parts", F.col("cut_no").isNotNull())
        .withColumn("__sep", sep)
        .groupBy("bundle_id", *keep, "part_no", "in_parts")
        .agg(ordered.alias("__blocks"), F.first("__sep").alias("__sep"))
        .select(
            "bundle_id", *keep, "part_no", "in_parts",
            F.call_function("array_join", F.col("__blocks"), F.col("__sep")).alias("text"),
        )
        .withMetadata("part_no", {ONE_ROW: True})
    )


def _cut_by_bounds(blocks: DataFrame, cut: DataFrame) -> DataFrame:
    """``blocks`` with the ``cut_no`` of their position. Numbers rise with positions, so first positions tell all."""
    places = F.floor(F.col("entry_idx") / F.lit(PLACES))
    starts = cut.groupBy("bundle_id", places.alias("__places"), "cut_no").agg(F.min("entry_idx").alias("start"))
    bounds = starts.groupBy("bundle_id", "__places").agg(
        F.array_sort(F.collect_list(F.struct("start", "cut_no"))).alias("__bounds"))
    passed = F.filter("__bounds", lambda b: b["start"] <= F.col("entry_idx"))
    return (
        blocks.withColumn("__places", places)
        .join(F.broadcast(bounds), ["bundle_id", "__places"], "left")
        .withColumn("cut_no", F.try_element_at(passed, F.lit(-1))["cut_no"])
        .drop("__places", "__bounds")
    )


def format_bundles(entries: DataFrame, profile: str | None = None,
                   registry: ProfileRegistry | None = None, on_problem: str = "fail",
                   max_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    """``bundle_id, profile, part_no, in_parts, text``; see :func:`assemble` for parts."""
    registry = registry or default_registry()
    blocks = format_blocks(entries, profile, registry, on_problem).select(
        "bundle_id", "profile", "entry_idx", "block"
    )
    profiles = [registry.get(profile)] if profile is not None else registry.all()
    pick = _chooser(profiles, None if profile is not None else F.col("profile"))
    return assemble(blocks, pick(lambda p: F.lit(p.separator)), max_bytes, keep=("profile",))


def convert_bundles(bundles: DataFrame, target: str, source: str | None = None,
                    registry: ProfileRegistry | None = None) -> DataFrame:
    """Parse in one format, write in another."""
    return format_bundles(parse_bundles(bundles, source, registry=registry), target, registry)


def format_diagnostics(entries: DataFrame, profile: str,
                       registry: ProfileRegistry | None = None) -> DataFrame:
    """What goes into each block, as a table."""
    p = (registry or default_registry()).get(profile)
    ready = p.prepare({c: F.col(c) for c in _USED})
    return entries.select(
        "bundle_id", "entry_idx", "path", "is_binary",
        ready["encoding"].alias("encoding"), ready["eol_style"].alias("eol_style"),
        F.length("content").alias("content_length"),
        (~F.col("is_binary") & p.lossy(F.col("content"))).alias("lossy"),
    )
