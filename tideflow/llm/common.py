"""Shared folder for intermediate tables, row keys and small column helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
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


class Workspace:
    """Intermediate tables of one query, written to the shared folder and read back.

    A written table cuts the lineage and survives lost executors. ``drop`` deletes tables that
    nothing reads any more; what a returned DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def table(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def only(self, df: DataFrame) -> DataFrame:
        """``df`` as the one table that is left of all."""
        out = self.table(df)
        for n in range(1, self.n):
            self._delete(f"{self.root}/{n}")
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in (getattr(t, "_workspace_path", None) for t in tables):
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system: Spark keeps workers, and what each has held adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_of(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of a bitmap row, and powers of two of bits that filters have at least and at most: 32 KB to 128 MB.
ROW_BITS, LEAST_BITS, MOST_BITS = 15, 18, 30


def bitmaps(hashes: DataFrame, work: Workspace, most: int = MOST_BITS) -> DataFrame:
    """A filter of the values of ``h``: rows (_bucket, _bits) of bitmaps, 16 bits a value as far as ``most`` goes.

    It only spares shuffling rows that join nothing: a full one lets all through. ``hashes`` is read once.
    """
    held = work.table(hashes.select("h"))
    bits = min(most, max(LEAST_BITS, (16 * held.count()).bit_length()))
    at = F.pmod(F.col("h"), F.lit(1 << bits))
    placed = held.select(F.shiftright(at, ROW_BITS).alias("_bucket"), at.bitwiseAND((1 << ROW_BITS) - 1).alias("_bit"))
    # dealt by bitmap first, so that no task holds partial copies of all of them
    out = work.table(placed.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    work.drop(held)
    out._filter_bits = bits
    return out


def in_bitmaps(df: DataFrame, filter: DataFrame, h: str, flag: str) -> DataFrame:
    """``df`` and ``flag``: whether column ``h`` is in the filter. True for all its values, and for a share of others that grows with its load."""
    bucket, bits, own = fresh(df, "_bucket", "_bits", "_own")
    size = 1 << filter._filter_bits
    at = F.pmod(F.col(h), F.lit(size))
    bit = at.bitwiseAND((1 << ROW_BITS) - 1)
    rows = filter.select(F.col("_bucket").alias(bucket), F.col("_bits").alias(bits))
    near = df.withColumn(own, F.shiftright(at, ROW_BITS)).join(F.broadcast(rows), F.col(own) == F.col(bucket), "left")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(bit, 3).cast("int") + 1, 1)), 16, 10).cast("int")
    return near.withColumn(flag, F.coalesce(F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1, F.lit(False))).drop(bucket, bits, own)


def maybe(df: DataFrame, filter: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``h`` is in the filter."""
    (flag,) = fresh(df, "_in")
    return in_bitmaps(df, filter, "h", flag).where(F.col(flag)).drop(flag)
