"""Chunked ordered scans: running sums and minima within a key, computed
without sending a whole key to one task.

A plain ``Window.partitionBy(key).orderBy(seq)`` puts every row of a key in
one task.  Here each key is cut into chunks of the ordering column
(``chunk = seq div chunk_span``); windows run per (key, chunk) in parallel,
a small per-(key, chunk) summary is scanned in chunk order, and the summary
is joined back.  The result equals the plain window exactly.  The summary
has one row per (key, chunk), so even a key holding a third of all rows
spreads over ``rows / chunk_span`` tasks.

The rows and their summary are two branches over one input.  Nothing is cached:
the plan is the same at every size, the summary's branch reads only the columns
it needs, and exchanges that come out equal are reused by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK_SPAN = 1 << 20


def _chunk(order: str, chunk_span: int) -> Column:
    return F.floor(F.col(order) / F.lit(int(chunk_span))).cast("bigint")


def running_sum(df: DataFrame, keys: list[str], order: str, value: str,
                chunk_span: int = DEFAULT_CHUNK_SPAN, out: str = "run") -> DataFrame:
    """Inclusive running ``sum(value)`` per key in ``order``, as ``out``.

    ``keys`` must be non-null; ``order`` unique within a key.
    """
    ck = "__chunk"
    d = df.withColumn(ck, _chunk(order, chunk_span))
    w = Window.partitionBy(*keys, ck).orderBy(order)
    local = d.withColumn("__run", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*keys).orderBy(ck).rowsBetween(Window.unboundedPreceding, -1)
    starts = (d.groupBy(*keys, ck).agg(F.sum(value).alias("__total"))  # partial sums straight from the input
               .select(*keys, ck, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start")))
    whole = dict(df.dtypes)[value] in ("bigint", "int", "smallint", "tinyint")
    return (local.join(starts, [*keys, ck])
                 .withColumn(out, (F.col("__start") + F.col("__run")).cast("bigint" if whole else "double"))
                 .drop(ck, "__run", "__start"))


def running_balance(df: DataFrame, keys: list[str], order: str, step: str,
                    chunk_span: int = DEFAULT_CHUNK_SPAN) -> DataFrame:
    """Running balance of ``step`` per key in ``order``, seen both ways.  Adds

    ``bal``        the balance after the row,
    ``floor``      ``least(0, lowest balance after any earlier row)``,
    ``later_min``  the lowest balance after any later row (null: none),
    ``__chunk``    the row's chunk; rows stay partitioned by (keys, chunk), so
                   windows per (keys, chunk, more) need no further shuffle.
    """
    ck = "__chunk"
    d = df.withColumn(ck, _chunk(order, chunk_span))
    w = Window.partitionBy(*keys, ck)
    up_to, behind = w.orderBy(order), w.orderBy(F.col(order).desc())
    earlier = (Window.unboundedPreceding, -1)
    local = d.withColumn("__run", F.sum(step).over(up_to.rowsBetween(Window.unboundedPreceding, 0)))
    # one row per (key, chunk): where the chunk ends and its lowest balance
    ends = local.groupBy(*keys, ck).agg(F.sum(step).alias("__total"), F.min("__run").alias("__low"))
    k = Window.partitionBy(*keys)
    ends = ends.withColumn("__start", F.coalesce(F.sum("__total").over(k.orderBy(ck).rowsBetween(*earlier)), F.lit(0)))
    low = F.col("__start") + F.col("__low")
    ends = ends.select(*keys, ck, "__start", F.min(low).over(k.orderBy(ck).rowsBetween(*earlier)).alias("__low_before"),
                       F.min(low).over(k.orderBy(F.col(ck).desc()).rowsBetween(*earlier)).alias("__low_after"))
    seen = local.withColumns({"__least_before": F.min("__run").over(up_to.rowsBetween(*earlier)),
                              "__least_after": F.min("__run").over(behind.rowsBetween(*earlier))})
    start = F.col("__start")
    return (seen.join(ends, [*keys, ck])
                .withColumns({
                    "bal": (start + F.col("__run")).cast("bigint"),
                    # least() skips nulls
                    "floor": F.least(F.lit(0), F.col("__low_before"), start + F.col("__least_before")).cast("bigint"),
                    "later_min": F.least(F.col("__low_after"), start + F.col("__least_after")).cast("bigint")})
                .drop("__run", "__start", "__low_before", "__low_after", "__least_before", "__least_after"))
