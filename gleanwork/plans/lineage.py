"""Cutting lineage and choosing join sides, both safe on a cluster that loses executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when measured to hold at most about so many bytes.
BROADCAST_BYTES = 4 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one is made only for a local master without any."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(found)
        return found
    if not sc.master.startswith(("local[", "local")) or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="gleanwork-checkpoint-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder; later reads survive the loss of an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """As :func:`cut`, as a parquet table of the shared folder, dropped when the program ends.

    For loops that join a frame with itself: a checkpoint keeps its plan's size estimate, which such a
    loop squares every round; a table has the size of its files.
    """
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    drop_at_end(spark, at)
    return spark.read.schema(df.schema).parquet(at)


def drop_at_end(spark: SparkSession, folder: str) -> None:
    """Has ``folder`` deleted when the program ends."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(conf).deleteOnExit(path)


def _width(c: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in a row of a join's hash table."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.aggregate(F.coalesce(c, F.array().cast(kind)), F.lit(16).cast("bigint"), lambda s, x: s + F.coalesce(_width(x, inner), F.lit(0)).cast("bigint"))
        return F.coalesce(F.size(c), F.lit(0)) * 8 + 16
    if isinstance(kind, T.MapType):
        return _width(F.map_keys(c), T.ArrayType(kind.keyType)) + _width(F.map_values(c), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind), F.lit(8))
    return F.lit(8)


def is_small(df: DataFrame, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is measured, over all its rows, to hold at most about ``size`` bytes.

    Meant for materialised frames (see :func:`cut`): a job runs that adds up widths where the rows are.
    """
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(8))
    return (df.agg(F.sum(width.cast("bigint")).alias("w")).first().w or 0) <= size


def small_side(df: DataFrame, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is measured to be small, else as it is: beyond the bound the
    join shuffles, and adaptive execution splits hot keys."""
    return F.broadcast(df) if is_small(df, size) else df


def left_lookup(df: DataFrame, side: DataFrame, on: str) -> DataFrame:
    """``df`` left joined with ``side`` (one row per non-null ``on``). Where the side is too large to
    broadcast, rows without ``on`` are spread over the tasks instead of going to one of them."""
    if is_small(side):
        return df.join(F.broadcast(side), on, "left")
    lone = F.struct(F.col(on).alias("k"), F.when(F.col(on).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(F.lit(-1).cast("bigint")).alias("s"))
    keyed = side.where(F.col(on).isNotNull()).withColumn("_k", F.struct(F.col(on).alias("k"), F.lit(-1).cast("bigint").alias("s"))).drop(on)
    spread = df.withColumn("_k", lone)
    same = (F.coalesce(spread["_k"]["k"].cast("string"), F.lit("")) == F.coalesce(keyed["_k"]["k"].cast("string"), F.lit(""))) & (spread["_k"]["s"] == keyed["_k"]["s"])
    return spread.join(keyed, same, "left").drop("_k")
