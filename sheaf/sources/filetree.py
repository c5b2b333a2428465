"""File trees as tables.

``filetree`` lists: the driver only opens the top directories until there is enough to share out,
the tasks walk the rest. Names are dealt out before sizes are looked up. Listing rows carry no content,
so path and size rules are applied before a byte is read; :func:`read_heads` and
:func:`read_contents` then read what is left. ``binaryFile`` is not used because
it drops hidden, underscore and empty files.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator, Sequence
from itertools import batched, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sheaf.functions.content import is_binary
from sheaf.functions.globs import DEFAULT_DENY, GlobFilter
from sheaf.functions.paths import order_key, relative_to
from sheaf.operators.manifest import union_sources
from sheaf.session import deal_out

LISTING = "abs_path string, length bigint"
READ_BATCH_BYTES = 32 * 1024 * 1024
HEAD_BYTES = 8192
CHUNK_BYTES = 1024 * 1024
NAMES_PER_BATCH = 65536


class _Folders(InputPartition):
    """Directories to walk, and directories of which only the files are wanted."""

    def __init__(self, deep: list[str], flat: list[str]):
        self.deep, self.flat = deep, flat


class FileTreeReader(DataSourceReader):
    """Names only: no file is looked at here, so that a folder of very many files costs its listing
    and no more. Sizes are asked for afterwards, by all tasks."""

    def __init__(self, root: str, slices: int):
        self.root, self.slices = os.path.abspath(root), slices

    def partitions(self) -> list[InputPartition]:
        if not os.path.exists(self.root):
            raise FileNotFoundError(f"Source path does not exist: {self.root}")
        if os.path.isfile(self.root):
            return [_Folders([], [self.root])]
        deep, flat = [self.root], []
        while deep and len(deep) < self.slices * 4:
            level = [d for folder in deep for d in _subfolders(folder)]
            flat += deep
            deep = level
        n = max(1, min(self.slices, len(deep) + len(flat)))
        return [_Folders(deep[i::n], flat[i::n]) for i in range(n)]

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        flat = (name for folder in partition.flat for name in _names(folder, deep=False))
        deep = (name for folder in partition.deep for name in _names(folder, deep=True))
        for names in batched(chain(flat, deep), NAMES_PER_BATCH):
            yield pa.RecordBatch.from_pydict({"abs_path": pa.array(names, pa.string())})


def _subfolders(folder: str) -> list[str]:
    with os.scandir(folder) as found:
        return sorted(e.path for e in found if e.is_dir(follow_symlinks=False))


def _names(top: str, deep: bool) -> Iterator[str]:
    """Everything below a folder that is no folder. One that cannot be read stops the job, on
    whatever level it is met."""
    if os.path.isfile(top):
        yield top
        return
    folders = [top]
    while folders:
        with os.scandir(folders.pop()) as found:
            for e in found:
                if not e.is_dir(follow_symlinks=False):
                    yield e.path
                elif deep:
                    folders.append(e.path)


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of regular files; a name that cannot be looked up keeps its error."""
    for batch in batches:
        rows: list[tuple[str, int | None, str | None]] = []
        for path in batch.column("abs_path").to_pylist():
            try:
                info = os.stat(path)
            except OSError as e:  # gone meanwhile, a link to nothing, or not allowed
                rows.append((path, None, e.strerror or type(e).__name__))
                continue
            if stat.S_ISREG(info.st_mode):
                rows.append((path, info.st_size, None))
        yield pa.RecordBatch.from_pydict({
            "abs_path": pa.array([r[0] for r in rows], pa.string()),
            "length": pa.array([r[1] for r in rows], pa.int64()),
            "error": pa.array([r[2] for r in rows], pa.string()),
        })


class FileTreeSource(DataSource):
    """``spark.read.format("filetree").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "abs_path string"

    def reader(self, schema) -> DataSourceReader:
        return FileTreeReader(self.options["path"], int(self.options.get("slices", "64")))


def list_names(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(FileTreeSource)
    slices = spark.sparkContext.defaultParallelism
    return spark.read.format("filetree").option("slices", slices).load(root)


def look_up_files(spark: SparkSession, root: str) -> DataFrame:
    """``abs_path, length, error``: every name below the root, dealt out over all tasks before it is
    looked up, so that one folder with all files is the work of many. A file that cannot be looked
    up is a row with an error and no length."""
    return deal_out(list_names(spark, root), "abs_path").mapInArrow(_look_up, f"{LISTING}, error string")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    return look_up_files(spark, root).filter("error IS NULL").drop("error")


def unreadable_files(spark: SparkSession, root: str) -> DataFrame:
    """``abs_path, error`` of the names that a listing leaves out."""
    return look_up_files(spark, root).filter("error IS NOT NULL").select("abs_path", "error")


def discover_files(spark: SparkSession, sources: str | Sequence[str], base: str | None = None,
                   allow: Sequence[str] | None = None, deny: Sequence[str] | None = DEFAULT_DENY,
                   bundle_id: str = "bundle") -> DataFrame:
    """``bundle_id, source_ord, path, abs_path, length`` of the files the globs let through.

    ``path`` is relative to ``base``, else to the source itself (its parent for a single file);
    files outside the base are skipped. Several sources are concatenated in order.
    """
    globs = GlobFilter(allow, deny)
    listings = []
    for source in [sources] if isinstance(sources, str) else sources:
        root = os.path.abspath(source)
        below = os.path.abspath(base) if base else (os.path.dirname(root) if os.path.isfile(root) else root)
        rel = relative_to(F.col("abs_path"), below)
        listings.append(
            list_files(spark, root)
            .withColumn("path", rel)
            .filter(F.col("path").isNotNull() & globs.includes(F.col("path")))
        )
    return union_sources(listings).select(
        F.lit(bundle_id).alias("bundle_id"), "source_ord", "path", "abs_path", "length"
    )


def in_discovery_order(files: DataFrame) -> DataFrame:
    return files.orderBy("source_ord", order_key(F.col("path")))


def read_contents(listing: DataFrame) -> DataFrame:
    """``content`` of every listed file; a file that has gone since the listing is left out.

    Rows are spread by path, not by directory, so one large directory does not stay in one task.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema.fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("abs_path").to_pylist()
            picked: list[int] = []
            data: list[bytes] = []
            held = 0
            for i, path in enumerate(paths):
                try:
                    with open(path, "rb") as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
                picked.append(i)
                data.append(content)
                held += len(content)
                if held >= READ_BATCH_BYTES:
                    yield _with_column(batch, picked, "content", pa.array(data, pa.binary()))
                    picked, data, held = [], [], 0
            yield _with_column(batch, picked, "content", pa.array(data, pa.binary()))

    return deal_out(listing, "abs_path").mapInArrow(read, f"{schema}, content binary")


def read_heads(listing: DataFrame, n_bytes: int = HEAD_BYTES) -> DataFrame:
    """``head``: the first ``n_bytes`` of every listed file, for rules that need no more, before
    contents are read. A file that has gone since the listing is left out."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema.fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, READ_BATCH_BYTES // n_bytes)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                picked, heads = [], []
                for i, path in enumerate(batch.column("abs_path").to_pylist()):
                    try:
                        with open(path, "rb", buffering=0) as f:
                            heads.append(f.read(n_bytes))
                    except FileNotFoundError:
                        continue
                    picked.append(i)
                yield _with_column(batch, picked, "head", pa.array(heads, pa.binary()))

    return deal_out(listing, "abs_path").mapInArrow(read, f"{schema}, head binary")


def sniff_files(listing: DataFrame) -> DataFrame:
    """``is_binary`` of every listed file, from its head."""
    return read_heads(listing).withColumn("is_binary", is_binary(F.col("head"))).drop("head")


def digest_files(listing: DataFrame) -> DataFrame:
    """``sha256, n_read, digest_error``: the checksum of every listed file and the bytes behind it.

    A file is read in chunks of ``CHUNK_BYTES`` inside its task, so its size is bounded by neither
    memory nor a cell. A file that cannot be read is a row with an error and no checksum.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema.fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, sizes, errors = [], [], []
            for path in batch.column("abs_path").to_pylist():
                digest, n, error = hashlib.sha256(), 0, None
                try:
                    with open(path, "rb", buffering=0) as f:
                        while chunk := f.read(CHUNK_BYTES):
                            digest.update(chunk)
                            n += len(chunk)
                except OSError as e:
                    error = e.strerror or type(e).__name__
                sums.append(None if error else digest.hexdigest())
                sizes.append(n)
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sums, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())],
                [*batch.schema.names, "sha256", "n_read", "digest_error"],
            )

    return deal_out(listing, "abs_path").mapInArrow(
        read, f"{schema}, sha256 string, n_read bigint, digest_error string")


def _with_column(batch: pa.RecordBatch, picked: list[int], name: str, values: pa.Array) -> pa.RecordBatch:
    kept = batch.take(pa.array(picked, pa.int64()))
    return pa.RecordBatch.from_arrays([*kept.columns, values], [*kept.schema.names, name])


def python_files(listing: DataFrame) -> DataFrame:
    return listing.filter(F.rlike("abs_path", F.lit(r"(?is)[^/]\.py\z")))
