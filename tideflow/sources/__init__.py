"""Sources and sinks."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in local mode without that setting."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path and sc._jsc.sc().getCheckpointDir().isDefined():
        path = sc._jsc.sc().getCheckpointDir().get()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tideflow-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scan_parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scan_rows(spark: SparkSession, rows: Iterable[tuple], schema: str, fragments: int = 1) -> DataFrame:
    """An in-memory table dealt over ``fragments`` tasks."""
    return spark.createDataFrame(list(rows), schema).repartition(max(1, fragments))


def scan_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line; only a line feed ends a line."""
    return spark.read.option("lineSep", "\n").text(path)


def generate(spark: SparkSession, task_count: int, fn: Callable[[int], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Source of ``task_count`` tasks; task i emits the batches of fn(i)."""

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from fn(i)

    if task_count < 1:
        return spark.createDataFrame([], schema)
    return spark.range(0, task_count, 1, task_count).mapInArrow(run, schema)


def write_text_single(df: DataFrame, path: str, *columns: str, sep: str = " ") -> None:
    """One text file, a line per row with the columns joined by ``sep``."""
    line = F.concat_ws(sep, *[F.col(c).cast("string") for c in columns or df.columns])
    df.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write(df: DataFrame, path: str, format: str = "parquet", partition_by: Iterable[str] = (), **options: Any) -> None:
    df.write.mode("overwrite").options(**options).partitionBy(*partition_by).format(format).save(path)


def collect_rows(df: DataFrame) -> list[tuple]:
    """A sink for results that the caller knows to fit in the driver."""
    return [tuple(r) for r in df.collect()]


def collect_groups(df: DataFrame, key: str, value: str) -> dict:
    """Key to list of values, for results that fit in the driver."""
    rows = df.groupBy(key).agg(F.collect_list(value).alias("vs")).collect()
    return {r[key]: list(r["vs"]) for r in rows}
