"""Where each entry goes, what happens to what is there, and the bytes to write.

Everything is planned as a table of actions before a file is touched. Placement works on
``bundle_id, entry_idx, target`` only; contents join the result through the unique entry key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import content as C
from sheaf.functions.paths import path_problem, resolve
from sheaf.operators.manifest import guard
from sheaf.operators.ordinal import running_sums
from sheaf.session import checkpoint

POLICIES = ("prompt", "skip", "overwrite", "rename")


def policy_name(policy: object) -> str:
    """An unknown policy is read as ``prompt``, which never loses a file."""
    name = str(getattr(policy, "value", policy)).lower()
    return name if name in POLICIES else "prompt"


def resolve_targets(entries: DataFrame, path_mode: str = "reroot") -> DataFrame:
    """``target`` relative to the output directory, ``error`` for a path that must not be written.

    ``reroot`` reads an absolute path below the output directory, ``strict`` refuses it.
    """
    resolved = entries.withColumn("__r", resolve(F.col("path")))
    error = F.when(
        F.col("__r.escaped"),
        F.concat(F.lit("Unsafe path '"), F.col("path"), F.lit("': escapes the output directory")),
    )
    if path_mode == "strict":
        refused = path_problem(F.col("path"))
        error = F.when(
            refused.isNotNull(),
            F.concat(F.lit("Unsafe path '"), F.col("path"), F.lit("': "), refused),
        ).otherwise(error)
    return resolved.withColumns({"target": F.col("__r.path"), "error": error}).drop("__r")


def _claims(targets: DataFrame, existing: DataFrame) -> DataFrame:
    """Light rows of the entries that want a place, with ``taken``: held by a file or by an
    earlier entry. An entry whose content is ``broken`` never holds a place itself.

    The earliest sound entry of a target is found by a combined minimum and joined back on the
    unique entry key, so many entries on one target make no hot key. The light rows are
    checkpointed: several joins read them, and each would otherwise go through all contents again.
    """
    light = checkpoint(
        targets.filter(F.col("error").isNull()).select("bundle_id", "entry_idx", "target", "broken")
    )
    sound = light.filter(~F.col("broken"))
    firsts = sound.groupBy("bundle_id", "target").agg(F.min("entry_idx").alias("entry_idx"))
    free = firsts.join(existing, ["bundle_id", "target"], "left_anti").select(
        "bundle_id", "entry_idx", F.lit(False).alias("__taken")
    )
    holders = firsts.select("bundle_id", "target", F.col("entry_idx").alias("__holder")).unionByName(
        existing.select("bundle_id", "target", F.lit(-1).cast("bigint").alias("__holder"))
    ).groupBy("bundle_id", "target").agg(F.min("__holder").alias("__holder"))
    broken = light.filter("broken").join(holders, ["bundle_id", "target"], "left").select(
        "bundle_id", "entry_idx", "target", "broken",
        F.coalesce(F.col("__holder") < F.col("entry_idx"), F.lit(False)).alias("taken"),
    )
    return sound.join(free, ["bundle_id", "entry_idx"], "left").select(
        "bundle_id", "entry_idx", "target", "broken",
        F.coalesce("__taken", F.lit(True)).alias("taken"),
    ).unionByName(broken)


def conflicts(entries: DataFrame, existing: DataFrame, path_mode: str = "reroot") -> DataFrame:
    """Entries whose target is taken: what ``prompt`` refuses."""
    return (
        _claims(payload(resolve_targets(entries, path_mode)), existing)
        .filter("taken")
        .select("bundle_id", "entry_idx", "target")
    )


def _split_target(target: Column) -> dict[str, Column]:
    """Directory, stem and suffix, and the stem without its trailing numbers."""
    folder = F.regexp_extract(target, r"(?s)\A(.*/)?[^/]*\z", 1)
    name = F.substring_index(target, "/", -1)
    suffix = F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    return {
        "folder": folder, "stem": stem, "suffix": suffix,
        "root": F.regexp_replace(stem, r"(?:_[1-9][0-9]*)+\z", ""),
    }


def _numbered_parent(target: Column) -> Column:
    """``a.txt`` for ``a_3.txt``; null when the stem ends in no number."""
    p = _split_target(target)
    cut = F.regexp_extract(p["stem"], r"(?s)\A(.+)_[1-9][0-9]*\z", 1)
    return F.when(cut != "", F.concat(p["folder"], cut, p["suffix"]))


def _ancestors(target: Column) -> Column:
    """``a.t, a_1.t, a_1_2.t`` for ``a_1_2.t``: the names it is a numbered form of, and itself."""
    p = _split_target(target)
    numbers = F.regexp_extract_all(
        F.substring(p["stem"], F.length(p["root"]) + 1, F.length(p["stem"])),
        F.lit(r"(_[0-9]+)"), F.lit(1),
    )
    return F.transform(
        F.sequence(F.lit(0), F.size(numbers)),
        lambda k: F.concat(
            p["folder"], p["root"], F.array_join(F.slice(numbers, F.lit(1), k), ""), p["suffix"]
        ),
    )


def _components(names: DataFrame, demand: DataFrame) -> DataFrame:
    """``bundle_id, target, component`` for names whose placement another name takes part in.

    A name hands out numbers only if it is claimed and was, or may become, taken. Down from the
    plainest form, a name joins the component of the one above it if that one hands out numbers,
    and else starts its own. Components of one name are left out.
    """
    ladder = names.select(
        "bundle_id", "target", F.posexplode(_ancestors(F.col("target"))).alias("level", "step")
    )
    known = ladder.join(
        demand.withColumnRenamed("target", "step"), ["bundle_id", "step"], "left"
    ).groupBy("bundle_id", "target").agg(
        F.array_sort(F.collect_list(F.struct(
            "level", "step",
            F.col("contested").isNotNull().alias("claimed"),
            F.coalesce("contested", F.lit(False)).alias("contested"),
        ))).alias("steps")
    )
    start = F.struct(F.lit(None).cast("string").alias("component"), F.lit(False).alias("live"))
    climbed = F.aggregate(
        "steps", start,
        lambda acc, s: F.struct(
            F.when(acc["live"], acc["component"]).otherwise(s["step"]).alias("component"),
            (s["claimed"] & (s["contested"] | acc["live"])).alias("live"),
        ),
    )["component"]
    placed = known.select("bundle_id", "target", climbed.alias("component"))
    shared = placed.groupBy("bundle_id", "component").count().filter("count > 1")
    return placed.join(shared.drop("count"), ["bundle_id", "component"])


def rename_targets(claims: DataFrame, existing: DataFrame) -> DataFrame:
    """``bundle_id, entry_idx, target, final``: a taken target becomes ``stem_N.suffix`` with the
    lowest N free at that moment, entries being placed in order.

    Placing one name touches another only if the other is the first with numbers appended. Where
    no such neighbour is claimed, the j-th latecomer of a name gets the j-th number that is not on
    disk, by running counts of latecomers and of numbers on disk. Names whose claims do depend on
    each other are replayed in order, one component at a time, on rows that carry no content.
    """
    claims = checkpoint(claims.select("bundle_id", "entry_idx", "target", "taken"))
    demand = claims.groupBy("bundle_id", "target").agg(F.max("taken").alias("contested"))
    names = claims.select("bundle_id", "target").union(existing.select("bundle_id", "target")).distinct()
    family = ["bundle_id", "folder", "root", "suffix"]

    def with_family(df: DataFrame) -> DataFrame:
        p = _split_target(F.col("target"))
        return df.withColumns({k: p[k] for k in family[1:]})

    # Families in which some contested name has a numbered form that is claimed.
    below = demand.select("bundle_id", _numbered_parent(F.col("target")).alias("target")).filter(
        F.col("target").isNotNull()
    )
    tangled = with_family(
        demand.filter("contested").join(below, ["bundle_id", "target"], "left_semi")
    ).select(*family).distinct()
    component = checkpoint(_components(
        with_family(names).join(tangled, family, "left_semi").select("bundle_id", "target"), demand
    ))

    marked = claims.join(component, ["bundle_id", "target"], "left")
    clear = marked.filter(F.col("component").isNull()).drop("component")
    settled = clear.filter(~F.col("taken")).select(
        "bundle_id", "entry_idx", "target", F.col("target").alias("final")
    )
    p = _split_target(F.col("target"))
    numbered = _free_numbers(clear.filter("taken"), existing).select(
        "bundle_id", "entry_idx", "target",
        F.concat(
            p["folder"], p["stem"], F.lit("_"), F.col("number").cast("string"), p["suffix"]
        ).alias("final"),
    )
    on_disk = existing.select(
        "bundle_id", F.lit(-1).cast("bigint").alias("entry_idx"), "target"
    ).join(component, ["bundle_id", "target"])
    replayed = (
        marked.filter(F.col("component").isNotNull())
        .select("bundle_id", "component", "entry_idx", "target")
        .unionByName(on_disk)
        .withColumn("suffix", p["suffix"])
        .groupBy("bundle_id", "component")
        .applyInPandas(
            _place_in_order, "bundle_id string, entry_idx bigint, target string, final string"
        )
    )
    return settled.unionByName(numbered).unionByName(replayed)


def _free_numbers(late: DataFrame, existing: DataFrame) -> DataFrame:
    """``bundle_id, entry_idx, target, number``: the j-th latecomer of a target gets the j-th number
    whose numbered form does not exist.

    Before the i-th number on disk, o, there are o - i free ones. So the j-th free number is j plus
    how many numbers on disk have fewer than j free ones before them.
    """
    keys = ["bundle_id", "target"]
    turns = running_sums(late.withColumn("one", F.lit(1)), keys, "entry_idx", ["one"]).select(
        *keys, "entry_idx", (F.col("one_before") + 1).alias("turn"))
    digits = F.regexp_extract(_split_target(F.col("target"))["stem"], r"_([1-9][0-9]*)\z", 1)
    # Numbers of more digits are beyond any count of claims.
    on_disk = existing.filter(F.length(digits).between(1, 17)).select(
        "bundle_id", _numbered_parent(F.col("target")).alias("target"), digits.try_cast("bigint").alias("number")
    ).distinct().join(late.select(*keys).distinct(), keys, "left_semi").withColumn("one", F.lit(1))
    free_before = running_sums(on_disk, keys, "number", ["one"]).groupBy(
        *keys, (F.col("number") - F.col("one_before") - 1).alias("free")).agg(F.count(F.lit(1)).alias("numbers"))
    # A latecomer's turn lies before the numbers with as many free ones before them.
    both = turns.select(*keys, "entry_idx", (2 * F.col("turn")).alias("at"), F.lit(0).cast("bigint").alias("numbers")).unionByName(
        free_before.select(*keys, F.lit(None).cast("bigint").alias("entry_idx"), (2 * F.col("free") + 1).alias("at"), "numbers"))
    return running_sums(both, keys, "at", ["numbers"]).filter("entry_idx IS NOT NULL").select(
        *keys, "entry_idx", (F.col("at") / 2 + F.col("numbers_before")).cast("bigint").alias("number"))


def _place_in_order(rows: pd.DataFrame) -> pd.DataFrame:
    suffix = rows["suffix"].iat[0] or ""
    taken = set(rows.loc[rows["entry_idx"] < 0, "target"])
    placed = rows[rows["entry_idx"] >= 0].sort_values("entry_idx")
    next_free: dict[str, int] = {}
    finals = []
    for target in placed["target"]:
        final = target
        if final in taken:
            stem = target[: len(target) - len(suffix)]
            n = next_free.get(target, 1)
            while (final := f"{stem}_{n}{suffix}") in taken:
                n += 1
            next_free[target] = n + 1
        taken.add(final)
        finals.append(final)
    return placed[["bundle_id", "entry_idx", "target"]].assign(final=finals)


def place(targets: DataFrame, existing: DataFrame, policy: object = "prompt") -> DataFrame:
    """``bundle_id, entry_idx, target, status, renamed_from`` for the entries with a safe path."""
    policy = policy_name(policy)
    none = F.lit(None).cast("string")
    if policy == "overwrite":  # nothing that is there matters
        return targets.filter(F.col("error").isNull()).select(
            "bundle_id", "entry_idx", "target",
            F.when(F.col("broken"), F.lit("error")).otherwise("processed").alias("status"),
            none.alias("renamed_from"),
        )
    claims = _claims(targets, existing)
    if policy == "rename":
        sound = rename_targets(claims.filter(~F.col("broken")), existing).select(
            "bundle_id", "entry_idx", F.col("final").alias("target"),
            F.lit("processed").alias("status"),
            F.when(F.col("final") != F.col("target"), F.col("target")).alias("renamed_from"),
        )
        return sound.unionByName(
            claims.filter("broken").select(
                "bundle_id", "entry_idx", "target",
                F.lit("error").alias("status"), none.alias("renamed_from"),
            )
        )
    if policy == "prompt":
        message = F.concat(
            F.lit("File '"), F.col("target"), F.lit("' already exists and overwrite not permitted")
        )
        claims = claims.filter(guard(F.col("taken"), message))
    status = F.when(F.col("broken"), F.lit("error")).otherwise("processed")
    if policy == "skip":
        status = F.when(F.col("taken"), F.lit("skipped")).otherwise(status)
    return claims.select(
        "bundle_id", "entry_idx", "target", status.alias("status"), none.alias("renamed_from")
    )


def payload(targets: DataFrame, add_headers: bool = True, **header: str) -> DataFrame:
    """``payload binary``, or ``broken`` with a ``payload_error`` when the content does not turn
    into bytes."""
    binary = F.col("is_binary")
    text = F.col("content")
    if add_headers:
        text = F.concat(C.header_block(F.col("path"), **header), text)
    encoded = C.encoded_text(F.when(~binary, text), F.when(~binary, F.col("encoding")))
    made = targets.withColumn("__encoded", F.when(~binary, encoded)).withColumn(
        "payload",
        F.when(binary, C.from_base64(F.when(binary, F.col("content")))).otherwise(F.col("__encoded.payload")),
    )
    reason = F.when(binary, F.lit("Binary decode failed")).otherwise(
        F.concat(F.lit("Encoding failed: "), F.coalesce("__encoded.error", F.lit("no content")))
    )
    broken = F.col("payload").isNull()
    return made.withColumns({"broken": broken, "payload_error": F.when(broken, reason)}).drop("__encoded")


def plan_extraction(entries: DataFrame, existing: DataFrame, policy: object = "prompt",
                    add_headers: bool = True, path_mode: str = "reroot",
                    **header: str) -> DataFrame:
    """``bundle_id, entry_idx, path, target, status, renamed_from, error, payload``.

    The plan is the dry run; writing it is ``sources.sinks.write_actions``. ``status`` is
    ``processed``, ``skipped`` or ``error``. A ``prompt`` conflict stops the plan before anything
    is written. The existing files are ``existing(bundle_id, target)``.
    """
    sized = payload(resolve_targets(entries, path_mode), add_headers, **header)
    placed = place(sized, existing, policy)
    joined = sized.drop("target").join(placed, ["bundle_id", "entry_idx"], "left")
    status = F.coalesce("status", F.lit("error"))
    return joined.select(
        "bundle_id", "entry_idx", "path", "target", status.alias("status"), "renamed_from",
        F.when(status == "error", F.coalesce("error", "payload_error")).alias("error"),
        F.when(status == "processed", F.col("payload")).alias("payload"),
    )


def extraction_stats(actions: DataFrame) -> DataFrame:
    return actions.groupBy("bundle_id").agg(
        F.count_if(F.col("status") == "processed").alias("processed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
