"""Bundle text to entries.

A bundle is one row, and everything its format needs to know is inside that row. So parsing is a
projection: the text is split into blocks, the blocks become structs, duplicates and errors are
settled within the array, and the entries are exploded. Nothing is shuffled, and no bundle can
become a hot key. A bundle too large for one cell comes in parts (as from ``sources.blocks``), cut
at any line; what a part needs of the parts before it is found by an ordered pass over a few
numbers of each part, and its entries meet in shuffles keyed by path, never by bundle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.content import verify_checksum
from sheaf.functions.text import last_field
from sheaf.operators.once import once
from sheaf.profiles import Profile, ProfileRegistry, default_registry
from sheaf.profiles.base import DETECT_CHARS, entry_problem

_ENTRY_FIELDS = ("path", "content", "encoding", "is_binary", "eol_style")
#: Bits of a place for the block in its part; those above hold the part's number.
_PART_SHIFT = 20
#: Mark on ``part_no``: each number of a bundle is one row, as ``assemble`` makes them.
ONE_ROW = "one_row_a_part"
#: So many ids of failed bundles go into a condition; more are joined.
FAILED_IDS = 1000


def _chooser(profiles: list[Profile], name: Column | None):
    """``pick(f)``: ``f(profile)`` of the profile named in the row."""

    def pick(f) -> Column:
        if name is None:
            return f(profiles[0])
        return F.coalesce(*[F.when(name == p.name, f(p)) for p in profiles])

    return pick


def _structs(pieces: Column, pick, with_content: bool) -> Column:
    """Blocks to entry structs. Each stage is one pass, so no expression runs twice per block."""

    def located(block):
        body = pick(lambda p: p.body(block)) if with_content else F.lit("")
        return F.struct(
            pick(lambda p: p.path(block)).alias("path"),
            pick(lambda p: p.meta(block)).alias("meta"),
            body.alias("body"),
        )

    def fielded(s):
        return F.struct(
            s["path"].alias("path"), s["body"].alias("body"),
            pick(lambda p: _field_arrays(p, s["meta"])).alias("fields"),
        )

    usable = F.filter(
        F.transform(pieces, located), lambda s: pick(lambda p: p.usable(s["path"]))
    )
    return F.transform(F.transform(usable, fielded), lambda s: _finished(s, pick))


def _field_arrays(p: Profile, meta: Column) -> Column:
    keys, values = p.fields(meta)
    return F.struct(keys.alias("keys"), values.alias("values"))


def _finished(s: Column, pick) -> Column:
    def get(key):
        return last_field(s["fields"]["keys"], s["fields"]["values"], key)

    def one(p: Profile) -> Column:
        done = p.finish(s["path"], s["body"], get)
        return F.struct(*[done[n].alias(n) for n in _ENTRY_FIELDS])

    return pick(one)


def _repeats(entries: Column) -> Column:
    """Per entry, in order: does a later one carry the same path? Sorting keeps it n log n."""
    keyed = F.array_sort(
        F.transform(entries, lambda e, i: F.struct(e["path"].alias("path"), i.alias("i")))
    )
    following = F.slice(keyed, F.lit(2), F.greatest(F.size(keyed) - 1, F.lit(0)))
    marked = F.zip_with(
        keyed, following,
        lambda a, b: F.struct(
            a["i"].alias("i"), F.coalesce(a["path"] == b["path"], F.lit(False)).alias("again")
        ),
    )
    return F.transform(F.array_sort(marked), lambda m: m["again"])


def _keep_last(entries: Column) -> Column:
    paths = F.transform(entries, lambda e: e["path"])
    repeated = F.size(F.array_distinct(paths)) < F.size(paths)
    pairs = F.zip_with(
        entries, _repeats(entries), lambda e, again: F.struct(e.alias("e"), again.alias("again"))
    )
    kept = F.transform(F.filter(pairs, lambda x: ~x["again"]), lambda x: x["e"])
    return F.when(repeated, kept).otherwise(entries)


def _repeated_paths(entries: Column) -> Column:
    """Sorted paths that occur more than once."""
    paths = F.transform(entries, lambda e: e["path"])
    pairs = F.zip_with(
        paths, _repeats(entries), lambda p, again: F.when(again, p)
    )
    found = F.array_sort(F.array_distinct(F.filter(pairs, lambda p: p.isNotNull())))
    any_repeat = F.size(F.array_distinct(paths)) < F.size(paths)
    return F.when(any_repeat, found)


def duplicate_message(paths: Column) -> Column:
    quoted = F.array_join(F.transform(paths, lambda p: F.concat(F.lit("'"), p, F.lit("'"))), ", ")
    return F.concat(F.lit("Duplicate file paths found: {"), quoted, F.lit("}"))


def read_bundles(bundles: DataFrame, profile: str | None = None, auto_detect: bool = True,
                 registry: ProfileRegistry | None = None, with_content: bool = True) -> DataFrame:
    """One row per bundle: ``bundle_id, profile, entries array<struct>, problem``.

    ``problem`` tells why the bundle has no manifest, null when it has one.
    """
    registry = registry or default_registry()
    if profile is not None:
        profiles, named = [registry.get(profile)], bundles.withColumn("profile", F.lit(profile))
        name = None
    elif auto_detect:
        profiles = registry.all()
        named = bundles.withColumn("profile", registry.detect(F.col("text")))
        name = F.col("profile")
    else:
        raise ValueError("Must specify profile_name or enable auto_detect")

    pick = _chooser(profiles, name)
    raw = once(
        once(named, "bundle_id", "profile", "text"), "bundle_id", "profile",
        _structs(pick(lambda p: p.split(F.col("text"))), pick, with_content).alias("raw"),
    )

    def settle(p: Profile) -> Column:
        return _keep_last(F.col("raw")) if p.duplicate_paths == "last" else F.col("raw")

    def clash(p: Profile) -> Column:
        if p.duplicate_paths == "last":
            return F.lit(None).cast("array<string>")
        return _repeated_paths(F.col("raw"))

    settled = once(
        raw, "bundle_id", "profile",
        pick(settle).alias("entries"),
        F.try_element_at(
            F.filter(
                F.transform(F.col("raw"), lambda e: entry_problem(e["path"], e["eol_style"])),
                lambda m: m.isNotNull(),
            ),
            F.lit(1),
        ).alias("bad_entry"),
        pick(clash).alias("clash"),
    )
    problem = (
        F.when(
            F.col("profile").isNull(),
            F.lit(f"Profile detection failed: {registry.detection_error()}"),
        )
        .when(F.size("entries") == 0, F.lit("Parse error: No files found in bundle"))
        .when(
            F.col("bad_entry").isNotNull(), F.concat(F.lit("Unexpected error: "), F.col("bad_entry"))
        )
        .when(
            F.col("clash").isNotNull(),
            F.concat(F.lit("Unexpected error: "), duplicate_message(F.col("clash"))),
        )
    )
    return once(settled, "bundle_id", "profile", "entries", problem.alias("problem"))


def _as_entries(df: DataFrame, *extra: str) -> DataFrame:
    """Columns of the entry schema; parsed entries carry no checksum, size or content type."""
    return df.select(
        "bundle_id", *extra, "entry_idx", *_ENTRY_FIELDS,
        F.lit(None).cast("string").alias("checksum"),
        F.lit(None).cast("bigint").alias("file_size_bytes"),
        F.lit(None).cast("string").alias("content_type"),
    )


def parse_bundles(bundles: DataFrame, profile: str | None = None, auto_detect: bool = True,
                  registry: ProfileRegistry | None = None) -> DataFrame:
    """Entries of every readable bundle. Unreadable ones are listed by :func:`parse_errors`."""
    if "in_parts" in bundles.columns:
        whole, cut = _by_parts(bundles)
        return parse_bundles(whole, profile, auto_detect, registry).unionByName(
            parse_parts(cut, profile, registry)
        )
    read = read_bundles(bundles, profile, auto_detect, registry)
    exploded = read.filter(F.col("problem").isNull()).select(
        "bundle_id", "profile", F.posexplode("entries").alias("entry_idx", "e")
    )
    return _as_entries(
        exploded.select(
            "bundle_id", "profile", F.col("entry_idx").cast("bigint").alias("entry_idx"), "e.*"
        ),
        "profile",
    )


def parse_errors(bundles: DataFrame, profile: str | None = None, auto_detect: bool = True,
                 registry: ProfileRegistry | None = None) -> DataFrame:
    if "in_parts" in bundles.columns:
        whole, cut = _by_parts(bundles)
        registry = registry or default_registry()
        report = _report_of_parts(_with_profile(cut, profile, registry), registry)
        return parse_errors(whole, profile, auto_detect, registry).unionByName(
            report.filter(F.col("problem").isNotNull()).select("bundle_id", "profile", "problem"))
    read = read_bundles(bundles, profile, auto_detect, registry, with_content=False)
    return read.filter(F.col("problem").isNotNull()).select("bundle_id", "profile", "problem")


def _by_parts(bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bundles in one row, and the parts of the others."""
    return bundles.filter(~F.col("in_parts")).drop("part_no", "in_parts"), bundles.filter(F.col("in_parts")).drop("in_parts")


def _joined(parts: DataFrame) -> DataFrame:
    """One row for each part number of a bundle, keyed by both. Texts of one number are joined, sorted,
    so that each block has a place of its own."""
    named = [F.max("profile").alias("profile")] if "profile" in parts.columns else []
    text = F.array_join(F.array_sort(F.collect_list("text")), "")
    return parts.groupBy("bundle_id", "part_no").agg(*named, text.alias("text"))


def _apart(parts: DataFrame) -> bool:
    """Are rows that ``assemble`` has made still one for each part number? They may have been united
    since, so their keys are counted."""
    if not parts.schema["part_no"].metadata.get(ONE_ROW):
        return False
    return parts.groupBy("bundle_id", "part_no").count().filter("count > 1").isEmpty()


def _with_profile(parts: DataFrame, profile: str | None, registry: ProfileRegistry,
                  apart: bool = False) -> DataFrame:
    """Every part, once, with its bundle's format: the given one, the one of its column, or the one that
    the head of the first part shows, null if none. Texts of parts that are ``apart`` stay where they are."""
    if apart:
        parts = parts.withColumn("text", F.coalesce("text", F.lit("")))
    else:
        parts = _joined(parts)
    if profile is not None:
        return parts.withColumn("profile", F.lit(registry.get(profile).name))
    if "profile" in parts.columns:
        return parts
    heads = parts.groupBy("bundle_id").agg(F.min_by(F.substring("text", 1, DETECT_CHARS), "part_no").alias("head"))
    named = heads.select(F.col("bundle_id").alias("of_bundle"), registry.detect(F.col("head")).alias("profile"))
    return parts.join(named, F.col("bundle_id").eqNullSafe(F.col("of_bundle"))).drop("of_bundle")


def _numbered_in(part: Column, at: Column) -> Column:
    """Place of a block: its part's number above that of the block in the part."""
    full = F.raise_error(F.lit(f"a part has more than {1 << _PART_SHIFT} blocks")).cast("bigint")
    return F.when(at < (1 << _PART_SHIFT), F.shiftleft(part.cast("bigint"), _PART_SHIFT) + at).otherwise(full)


def _states_before(parts: DataFrame, pick) -> DataFrame:
    """``bundle_id, part_no, entry_idx, inside``: the block that is open where a part starts, null
    before the first, and whether that place is inside of a fence.

    Each part is a function on the two states. One with a header ends in a state of its own, and so
    does one in which a fence with a language opens; any other keeps the state or changes it. So a
    state is that of the last part of the first kind, changed as often as parts of the second kind
    follow. The rows that are ordered here hold a few numbers for each part.
    """
    last = F.element_at("pieces", -1)
    found = once(
        once(parts, "bundle_id", "profile", "part_no", pick(lambda p: p.pieces(F.col("text"))).alias("pieces")),
        "bundle_id", "part_no", (F.size("pieces") - 1).alias("headers"), pick(lambda p: p.moves(last)).alias("moves"),
    )
    sure = F.when((F.col("headers") > 0) | (F.col("moves.outside") == F.col("moves.inside")), F.col("moves.outside"))
    light = found.select(
        "bundle_id", "part_no", sure.alias("sure"),
        F.when(sure.isNull(), F.col("moves.outside")).otherwise(0).alias("change"),
        F.when(F.col("headers") > 0, _numbered_in(F.col("part_no"), F.col("headers"))).alias("opened"),
    )
    so_far = Window.partitionBy("bundle_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("bundle_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    counted = light.withColumn("changes", F.sum("change").over(so_far)).withColumn(
        "base", F.when(F.col("sure").isNotNull(), F.col("sure") + F.col("changes")))
    state = F.coalesce(F.last("base", True).over(before), F.lit(0)) + F.coalesce(F.last("changes").over(before), F.lit(0))
    return counted.select(
        "bundle_id", "part_no", F.last("opened", True).over(before).alias("entry_idx"), (state % 2 == 1).alias("inside"))


def _blocks_of_parts(parts: DataFrame, registry: ProfileRegistry, with_content: bool) -> DataFrame:
    """``bundle_id, profile, entry_idx, path, meta, body`` of every block, whole again where parts cut it.

    Only the last block of a part and what continues one in the next parts are shuffled, by block.
    """
    pick = _chooser(registry.all(), F.col("profile"))
    none, piece = F.lit(""), F.col("piece")
    pieces = once(parts, "bundle_id", "profile", "part_no", pick(lambda p: p.pieces(F.col("text"))).alias("pieces")).select(
        "bundle_id", "profile", "part_no", (F.size("pieces") - 1).alias("last"), F.posexplode("pieces").alias("at", "piece"))
    blocks = pieces.filter("at > 0").select(
        "bundle_id", "profile", _numbered_in(F.col("part_no"), F.col("at")).alias("entry_idx"), "part_no",
        (F.col("at") == F.col("last")).alias("open"), pick(lambda p: p.path(piece)).alias("path"),
        pick(lambda p: p.meta(piece)).alias("meta"), (pick(lambda p: p.body(piece)) if with_content else none).alias("body"))
    later = pieces.filter("at = 0 AND piece <> ''").join(
        _states_before(parts, pick).filter("entry_idx IS NOT NULL"), ["bundle_id", "part_no"]
    ).select(
        "bundle_id", "profile", "entry_idx", "part_no", F.lit(None).cast("string").alias("path"),
        pick(lambda p: p.later_meta(piece)).alias("meta"),
        (pick(lambda p: p.later_body(piece, F.col("inside"))) if with_content else none).alias("body"))
    ordered = F.array_sort(F.collect_list(F.struct("part_no", "meta", "body")))
    joined = blocks.filter("open").drop("open").unionByName(later).groupBy("bundle_id", "profile", "entry_idx").agg(
        F.max("path").alias("path"), ordered.alias("cut"))
    text = lambda field, sep: F.array_join(F.transform("cut", lambda x: x[field]), sep)
    return blocks.filter(~F.col("open")).drop("open", "part_no").unionByName(
        joined.select("bundle_id", "profile", "entry_idx", "path", text("meta", ";").alias("meta"), text("body", "").alias("body")))


def _entries_of_parts(parts: DataFrame, registry: ProfileRegistry, with_content: bool = True) -> DataFrame:
    pick = _chooser(registry.all(), F.col("profile"))
    fielded = _blocks_of_parts(parts, registry, with_content).filter(pick(lambda p: p.usable(F.col("path")))).select(
        "bundle_id", "profile", "entry_idx",
        F.struct(
            "path", "body", pick(lambda p: _field_arrays(p, F.col("meta"))).alias("fields")
        ).alias("s"),
    )
    return fielded.select(
        "bundle_id", "profile", "entry_idx", _finished(F.col("s"), pick).alias("e")
    ).select("bundle_id", "profile", "entry_idx", "e.*")


def _report_of_parts(named: DataFrame, registry: ProfileRegistry) -> DataFrame:
    """``bundle_id, profile, file_count, problem``, one row per bundle in parts.

    States of its paths are merged, those of a path first: how often it occurs, and the first block
    that is no entry. A message names all repeated paths, as it does for a whole text.
    """
    last_wins = [p.name for p in registry.all() if p.duplicate_paths == "last"]
    light = _entries_of_parts(named, registry, with_content=False)
    message = entry_problem(F.col("path"), F.col("eol_style"))
    by_path = light.groupBy("bundle_id", "profile", "path").agg(
        F.count(F.lit(1)).alias("times"),
        F.min(F.when(message.isNotNull(), F.struct("entry_idx", message.alias("message")))).alias("bad"))
    repeated = F.when((F.col("times") > 1) & ~F.col("profile").isin(*last_wins), F.col("path"))
    found = by_path.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("paths"), F.min("bad")["message"].alias("bad"), F.array_sort(F.collect_list(repeated)).alias("clash"))
    problem = (
        F.when(F.col("profile").isNull(), F.lit(f"Profile detection failed: {registry.detection_error()}"))
        .when(F.col("paths").isNull(), F.lit("Parse error: No files found in bundle"))
        .when(F.col("bad").isNotNull(), F.concat(F.lit("Unexpected error: "), F.col("bad")))
        .when(F.size("clash") > 0, F.concat(F.lit("Unexpected error: "), duplicate_message(F.col("clash"))))
    )
    bundles = named.groupBy("bundle_id").agg(F.max("profile").alias("profile"))
    return once(bundles.join(found, "bundle_id", "left"), "bundle_id", "profile", F.col("paths").alias("file_count"), problem.alias("problem")).select(
        "bundle_id", "profile", F.when(F.col("problem").isNull(), F.col("file_count")).otherwise(0).alias("file_count"), "problem")


def parse_parts(parts: DataFrame, profile: str | None = None,
                registry: ProfileRegistry | None = None) -> DataFrame:
    """Bundles whose text is spread over several rows, ``bundle_id, part_no, text`` and perhaps
    ``profile``, cut at any line. Rows of one ``part_no`` are one part.

    Repeats are settled by ``(bundle, path)``: for the last-wins format the rank filter already
    drops the losers before the shuffle. A bundle that fails is removed through the list of failed
    bundle ids; :func:`parse_errors` names it.

    Parts as ``format_bundles`` makes them are not shuffled but for the blocks at their ends: the failed
    bundles are found first, and repeats are ranked only where the format lets the last one win. In
    the others they fail their bundle.
    """
    registry = registry or default_registry()
    apart = _apart(parts)
    named = _with_profile(parts, profile, registry, apart)
    entries = _entries_of_parts(named, registry)
    failed = _report_of_parts(named, registry).filter("problem IS NOT NULL").select("bundle_id")
    if apart:
        ids = [r.bundle_id for r in failed.filter("bundle_id IS NOT NULL").limit(FAILED_IDS + 1).collect()]
        if len(ids) <= FAILED_IDS:
            failed = None
            entries = entries.filter(F.col("bundle_id").isNull() | ~F.col("bundle_id").isin(ids)) if ids else entries
    if apart and profile is not None and registry.get(profile).duplicate_paths != "last":
        kept = entries
    else:
        newest = Window.partitionBy("bundle_id", "path").orderBy(F.desc("entry_idx"))
        kept = entries.withColumn("__rank", F.row_number().over(newest)).filter(F.col("__rank") == 1).drop("__rank")
    if failed is not None:
        kept = kept.join(failed, "bundle_id", "left_anti")
    return _as_entries(kept, "profile")


def validate_bundles(bundles: DataFrame, profile: str | None = None,
                     registry: ProfileRegistry | None = None,
                     checksums: DataFrame | None = None) -> DataFrame:
    """``bundle_id, valid, profile, file_count, errors, warnings``, one row per bundle,
    also of bundles in parts.

    Failures are data. ``checksums(bundle_id, path, checksum)`` adds a check of the parsed
    contents against recorded digests; the paths named in its message all come out of the one
    text that the bundle is here, so their number is bounded by it.
    """
    registry = registry or default_registry()
    if profile is not None and profile not in registry.list_profiles():
        try:
            registry.get(profile)
        except KeyError as e:
            return bundles.select(
                "bundle_id", F.lit(False).alias("valid"), F.lit(None).cast("string").alias("profile"),
                F.lit(0).cast("bigint").alias("file_count"),
                F.array(F.lit(f"Unexpected error: {e}")).alias("errors"),
                F.array().cast("array<string>").alias("warnings"),
            )
    whole, cut = _by_parts(bundles) if "in_parts" in bundles.columns else (bundles, None)
    read = read_bundles(whole, profile, registry=registry, with_content=False)
    ok = F.col("problem").isNull()
    report = read.select(
        "bundle_id", "profile",
        F.when(ok, F.size("entries")).otherwise(0).cast("bigint").alias("file_count"),
        "problem",
    )
    if cut is not None:
        report = report.unionByName(_report_of_parts(_with_profile(cut, profile, registry), registry))
    mismatch = F.lit(None).cast("string")
    if checksums is not None:
        failed = (
            failed_checksums(parse_bundles(bundles, profile, registry=registry), checksums)
            .groupBy("bundle_id")
            .agg(F.array_sort(F.collect_list("path")).alias("__failed"))
        )
        report = report.join(failed, "bundle_id", "left")
        mismatch = F.when(
            F.col("__failed").isNotNull(),
            F.concat(
                F.lit("Checksum verification failed for: "), F.array_join("__failed", ", ")
            ),
        )
    errors = F.filter(F.array(F.col("problem"), mismatch), lambda m: m.isNotNull())
    return report.select(
        "bundle_id", (F.size(errors) == 0).alias("valid"), "profile", "file_count",
        errors.alias("errors"), F.array().cast("array<string>").alias("warnings"),
    )


def failed_checksums(entries: DataFrame, checksums: DataFrame) -> DataFrame:
    expected = checksums.select("bundle_id", "path", F.col("checksum").alias("expected"))
    return (
        entries.join(expected, ["bundle_id", "path"])
        .filter(~verify_checksum(F.col("content"), F.col("expected")))
        .select("bundle_id", "path")
    )


def detect_profiles(bundles: DataFrame, registry: ProfileRegistry | None = None) -> DataFrame:
    registry = registry or default_registry()
    return bundles.select("bundle_id", registry.detect(F.col("text")).alias("profile"))
