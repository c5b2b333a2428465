"""The registered queries' own helpers."""

import ast
import pathlib

from pyspark.sql import functions as F

import workload
from workload import inputs as I


def test_no_name_is_defined_twice():
    """A second helper of one name would take the place of the first in every query that calls it."""
    for path in pathlib.Path(workload.__file__).parent.glob("*.py"):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef)]
        assert sorted(names) == sorted(set(names)), path.name


def test_streams_of_one_file_and_of_a_folder(spark, tmp_path):
    """A larger table is a folder of files, each of which arrives."""
    rows = spark.range(40).select("id", F.lit("x").alias("text"))
    rows.repartition(4).write.parquet(f"{tmp_path}/folder/turns.parquet")
    rows.toPandas().to_parquet(f"{tmp_path}/turns.parquet")
    for sf in (f"{tmp_path}/folder", str(tmp_path)):
        out = f"{sf}/out"
        stream = I.arriving(spark, sf, "turns").writeStream.trigger(availableNow=True).option("checkpointLocation", f"{sf}/state")
        stream.format("parquet").start(out).awaitTermination()
        assert spark.read.parquet(out).agg(F.count("*"), F.sum("id")).first()[:] == (40, 780)
