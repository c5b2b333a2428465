"""Writers: extracted files, bundle files, event logs, catalogs and changelogs."""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sheaf import schemas
from sheaf.operators.manifest import guard
from sheaf.session import deal_out
from sheaf.sources.filetree import list_names


#: In a staging folder, the names of the task folders that count.
COUNTED = "_counted"


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int


class FileTreeWriter(DataSourceArrowWriter):
    """One file per target, written in two steps.

    A task writes below a folder of its own in the job's staging folder; neighbouring rows with one
    target are one file. The job's commit names the folders of the tasks that counted, so that a task
    that ran twice counts once; its abort drops everything. A second job then renames file by file,
    each task those dealt to it. The root is on a file system that all executors mount.
    """

    def __init__(self, staging: str):
        self.staging = staging

    def write(self, iterator) -> _Written:
        folder = os.path.join(self.staging, uuid.uuid4().hex)
        n, last, out = 0, None, None
        for batch in iterator:
            for target, data in zip(
                batch.column("target").to_pylist(), batch.column("payload").to_pylist()
            ):
                if target != last:
                    path = os.path.normpath(os.path.join(folder, target))
                    if not path.startswith(folder + os.sep) or os.path.isabs(target):
                        raise ValueError(f"Target outside of the output folder: {target!r}")
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    if out is not None:
                        out.close()
                    out, last, n = open(path, "wb"), target, n + 1  # noqa: SIM115
                out.write(data)
        if out is not None:
            out.close()
        return _Written(folder, n)

    def commit(self, messages) -> None:
        """Name the folders that count; :func:`write_files` has their files moved by tasks."""
        os.makedirs(self.staging, exist_ok=True)
        with open(os.path.join(self.staging, COUNTED), "w", encoding="utf-8") as f:
            f.writelines(f"{os.path.basename(m.folder)}\n" for m in messages if m is not None and m.files)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class FileTreeSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree_sink"

    def schema(self) -> str:
        return "target string, payload binary"

    def writer(self, schema, overwrite: bool) -> FileTreeWriter:
        return FileTreeWriter(self.options["path"])


def write_files(spark: SparkSession, files: DataFrame, root: str) -> None:
    """``files(target, payload)`` below ``root``. Parents are created; bytes are written as is. A
    target outside of the root fails the job before any file appears."""
    spark.dataSource.register(FileTreeSink)
    staging = os.path.join(os.path.abspath(root), f".staging-{uuid.uuid4().hex}")
    files.select("target", "payload").write.format("filetree_sink").mode("append").save(staging)
    _publish(spark, staging, os.path.abspath(root))
    shutil.rmtree(staging, ignore_errors=True)


def _publish(spark: SparkSession, staging: str, root: str) -> None:
    """Move the files of the folders that count into place. A task that is run again finds the files
    it has moved already at their places."""
    with open(os.path.join(staging, COUNTED), encoding="utf-8") as f:
        counted = f.read().split()
    if not counted:
        return

    def move(batches):
        for batch in batches:
            for path in batch.column("abs_path").to_pylist():
                folder, _, target = path[len(staging) + 1:].partition("/")
                if not target:
                    continue
                own = os.path.join(root, target)
                os.makedirs(os.path.dirname(own), exist_ok=True)
                try:
                    os.replace(path, own)
                except FileNotFoundError:
                    if not os.path.exists(own):
                        raise
            yield batch.slice(0, 0)

    folders = spark.createDataFrame([(c,) for c in counted], "folder string")
    names = list_names(spark, staging)
    folder = F.split_part(F.substring("abs_path", len(staging) + 2, 2**31 - 1), F.lit("/"), F.lit(1))
    moved = names.withColumn("folder", folder).join(F.broadcast(folders), "folder", "left_semi")
    # Both files of a target that two tasks have written go to one task, in the order of their names.
    dealt = deal_out(moved.withColumn("place", F.expr(f"substring(abs_path, {len(staging) + 2} + length(folder))")), "place")
    dealt.sortWithinPartitions("place", "abs_path").select("abs_path").mapInArrow(move, "abs_path string").write.format("noop").mode("append").save()


def folder_of(bundle_id: str) -> Column:
    """A folder or file name for a bundle: its id, encoded where it is not a plain name."""
    name = F.coalesce(F.col(bundle_id), F.lit(""))
    plain = F.rlike(name, F.lit(r"\A[\w-][\w .-]*\z"))
    return F.when(plain, name).otherwise(F.concat(F.lit("%"), F.url_encode(name)))


def write_actions(spark: SparkSession, actions: DataFrame, root: str, flat: bool = False) -> None:
    """The processed rows of an extraction plan, each bundle in a folder of its own. Two rows for
    one target (overwrite policy): the later entry is the one written.

    ``flat`` puts all bundles into the root itself; a target of several bundles then fails the job.
    """
    done = actions.filter("status = 'processed'")
    if flat:
        last = done.groupBy("target").agg(
            F.max("entry_idx").alias("entry_idx"), F.min("bundle_id").alias("bundle_id"),
            F.max("bundle_id").alias("__other"),
        ).filter(guard(
            F.col("bundle_id") != F.col("__other"),
            F.concat(F.lit("Several bundles extract to '"), F.col("target"), F.lit("'")),
        ))
        target = F.col("target")
    else:
        last = done.groupBy("bundle_id", "target").agg(F.max("entry_idx").alias("entry_idx"))
        target = F.concat(folder_of("bundle_id"), F.lit("/"), F.col("target"))
    keys = last.select("bundle_id", "entry_idx")
    final = done.join(keys, ["bundle_id", "entry_idx"], "left_semi")
    write_files(spark, final.select(target.alias("target"), "payload"), root)


def write_bundles(spark: SparkSession, bundles: DataFrame, root: str, suffix: str = ".txt",
                  separator: str = "") -> None:
    """One UTF-8 file per bundle, byte for byte; a bundle in parts gets one file per part, whose
    names sort in order. ``separator`` is the format's, and goes before every part but the first,
    so that the parts one after the other are the bundle."""
    parts = F.col("in_parts")
    name = F.when(
        parts, F.format_string("%s.%012d", folder_of("bundle_id"), F.col("part_no"))
    ).otherwise(folder_of("bundle_id"))
    lead = F.when(parts & (F.col("part_no") > 0), F.lit(separator)).otherwise("")
    write_files(
        spark,
        bundles.select(
            F.concat(name, F.lit(suffix)).alias("target"),
            F.concat(lead, F.col("text")).cast("binary").alias("payload"),
        ),
        root,
    )


def write_blocks_text(spark: SparkSession, blocks: DataFrame, root: str, separator: str = "") -> None:
    """Bundles of any size: per bundle a folder whose files, in name order, are the bundle, byte
    for byte.

    Rows are range-partitioned by bundle and position, so a large bundle is written by many tasks,
    each of which adds one file to it. The separator goes before every block but a bundle's first.
    """
    first = blocks.groupBy("bundle_id").agg(F.min("entry_idx").alias("__first"))
    lead = F.when(F.col("entry_idx") > F.col("__first"), F.lit(separator)).otherwise("")
    sliced = (
        blocks.join(first, "bundle_id")
        .select("bundle_id", "entry_idx", F.concat(lead, F.col("block")).alias("__text"))
        .repartitionByRange("bundle_id", "entry_idx")
        .sortWithinPartitions("bundle_id", "entry_idx")
    )
    target = F.format_string("%s/part-%08d", folder_of("bundle_id"), F.spark_partition_id())
    write_files(spark, sliced.select(target.alias("target"), F.col("__text").cast("binary").alias("payload")), root)


def append_log(events: DataFrame, path: str) -> None:
    """JSON lines; ``details`` is stored as an object, not as quoted text. A null field is null, and
    details that are no JSON become a string, so that every event is one readable line."""
    details = F.col("details")
    sound = F.try_parse_json(details).isNotNull()
    value = lambda c: F.coalesce(F.to_json(c.cast("variant")), F.lit("null"))
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    line = F.concat(
        F.lit('{"sessionId":'), value(F.col("sessionId")),
        F.lit(',"timestamp":'), F.coalesce(F.concat(F.lit('"'), stamp, F.lit('"')), F.lit("null")),
        F.lit(',"event":'), value(F.col("event")),
        F.lit(',"details":'),
        F.when(details.isNull(), F.lit("null")).when(sound, F.translate(details, "\n\r", "  ")).otherwise(value(details)),
        F.lit("}"),
    )
    events.select(line.alias("value")).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LOG).json(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").json(path)


def read_catalog(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """JSON lines, or with ``array_file`` one JSON array per file."""
    return spark.read.schema(schemas.CATALOG).option("multiLine", array_file).json(path)


def write_changelog(changes: DataFrame, path: str) -> None:
    changes.select(*schemas.CHANGE_COLUMNS).write.mode("overwrite").csv(
        path, header=True, escape='"', emptyValue="", nullValue=""
    )
