"""Run a streaming frame to completion (``availableNow``) into a folder of
the shared checkpoint area and read the result back as a batch frame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltrail.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/calltrail-{name}-{uuid.uuid4().hex}"


def append_step(stream: DataFrame, base: str) -> None:
    """Take what is new of an append-mode stream into ``<base>/out``."""
    (stream.writeStream.format("parquet").option("path", f"{base}/out")
           .option("checkpointLocation", f"{base}/ckpt").outputMode("append")
           .trigger(availableNow=True).start().awaitTermination())


def _update_step(stream: DataFrame, base: str) -> None:
    def write(df: DataFrame, epoch: int):
        # a replayed micro-batch overwrites what it wrote before
        (df.withColumn("__epoch", F.lit(int(epoch)).cast("bigint"))
           .write.mode("overwrite").parquet(f"{base}/out/epoch={int(epoch)}"))

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/ckpt")
           .outputMode("update").trigger(availableNow=True).start().awaitTermination())


def _latest(spark: SparkSession, base: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    full = T.StructType(schema.fields + [T.StructField("__epoch", T.LongType(), True)])
    hist = spark.read.schema(full).parquet(f"{base}/out/epoch=*")
    latest = hist.groupBy(*keys).agg(F.max("__epoch").alias("__last"))
    cond = [hist[k].eqNullSafe(latest[k]) for k in keys] + [hist["__epoch"] == latest["__last"]]
    return hist.join(latest, cond, "left_semi").drop("__epoch")


def run_append(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Append-mode stream -> Parquet file sink (exactly once) -> batch frame."""
    base = scratch(spark, name)
    append_step(stream, base)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_update(spark: SparkSession, stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Update-mode stream: every micro-batch writes its changed rows with the
    batch id; the current table is the latest version of each key."""
    base = scratch(spark, name)
    _update_step(stream, base)
    return _latest(spark, base, stream.schema, keys)


def run_loads(spark: SparkSession, loads: list[DataFrame], view, name: str,
              keys: list[str] | None = None) -> DataFrame:
    """``view`` of a stream whose rows arrive load by load: each load is added to
    a folder, then the stream, restarted from its checkpoint, takes what is new
    as one micro-batch.  Append mode, or update mode where ``keys`` are given."""
    base = scratch(spark, name)
    for load in loads:
        load.write.mode("append").parquet(f"{base}/in")
        stream = view(spark.readStream.schema(loads[0].schema).parquet(f"{base}/in"))
        append_step(stream, base) if keys is None else _update_step(stream, base)
    if keys is None:
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    return _latest(spark, base, stream.schema, keys)


__all__ = ["append_step", "run_append", "run_loads", "run_update", "scratch"]
