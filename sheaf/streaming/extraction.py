"""Extraction of entries as they arrive: what an earlier micro-batch has claimed stays claimed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheaf.operators.extract import plan_extraction

_CLAIMS = "bundle_id string, target string, batch bigint"


def extract_stream(entries: DataFrame, existing: DataFrame, out: str, checkpoint: str, policy: object = "rename",
                   available_now: bool = True, **options) -> StreamingQuery:
    """Plans of arriving entries, below ``out/actions``, with the policy of ``plan_extraction``.

    The state is a table of claims, below ``out/claims``: the existing files and the targets of the
    batches so far, names alone. A batch sees the claims of the batches before it and of its own
    bundles only. Both tables have a folder per batch, which a repeated batch replaces, so that it
    plans as it did before. The result is that of one plan over all entries if those of a bundle
    arrive in the order of ``entry_idx``.
    """
    existing.select("bundle_id", "target").distinct().write.mode("overwrite").parquet(f"{out}/claims/batch=-1")

    def publish(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        claimed = spark.read.schema(_CLAIMS).parquet(f"{out}/claims").filter(F.col("batch") < epoch)
        own = claimed.join(batch.select("bundle_id").distinct(), "bundle_id", "left_semi")
        plan = plan_extraction(batch, own.select("bundle_id", "target").distinct(), policy, **options)
        plan.write.mode("overwrite").parquet(f"{out}/actions/batch={epoch}")
        done = spark.read.schema("bundle_id string, target string, status string").parquet(f"{out}/actions/batch={epoch}")
        done.filter("status = 'processed'").select("bundle_id", "target").distinct().write.mode("overwrite").parquet(
            f"{out}/claims/batch={epoch}")

    writer = entries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def planned_actions(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/actions").drop("batch")
