"""The whole way from files to bundles as one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.globs import GlobFilter
from sheaf.operators.manifest import create_manifest, number_files
from sheaf.plans.formatting import format_bundles
from sheaf.session import checkpoint


def bundle_files(files: DataFrame, profile: str, allow: Sequence[str] | None = None,
                 deny: Sequence[str] | None = None, max_file_mb: float = 10.0, **writing) -> DataFrame:
    """``files(bundle_id, path, length, content)`` through the filter into bundles: ``bundle_id, files,
    part_no, in_parts, text, problem``.

    A bundle whose files are all left out is a row with a problem and no text; without any file at all
    there is nothing to name, which is an error. Files are filtered and numbered on the listing alone.
    """
    kept = GlobFilter(allow, deny).includes(F.col("path"))
    listing = files.select("bundle_id", "path")
    # Light rows, read by the counts and by the numbering, and the place where an empty input shows.
    counts = checkpoint(listing.groupBy("bundle_id").agg(F.count_if(kept).alias("files")))
    if counts.isEmpty():
        raise ValueError("no files to bundle")
    places = number_files(listing.filter(kept))
    entries = create_manifest(files.filter(kept).join(places, ["bundle_id", "path"]), max_file_mb)
    text = format_bundles(entries, profile, **writing)
    problem = F.when(F.col("files") == 0, F.lit("No files left to bundle"))
    return counts.join(text, "bundle_id", "left").select(
        "bundle_id", "files", "part_no", "in_parts", "text", problem.alias("problem"))
