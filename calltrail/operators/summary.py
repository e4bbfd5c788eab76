"""Aggregations: count (A1), stats (A2), app summary (A3), first-seen labels
(A4), per-batch sources (A5), method roll-up (A6), coverage check (A7).

All are hash aggregates with map-side partial aggregation, so a hot key is
combined inside each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltrail.functions.render import device_group_label, device_label


def total_count(df: DataFrame) -> DataFrame:
    """A1."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("total_events"))


def stats(df: DataFrame) -> DataFrame:
    """A2: total, count per device label (P7) and count per type in one scan.

    One ``GROUPING SETS ((device), (type), ())`` aggregate: the rows are
    expanded three-fold before the partial aggregate, which then shrinks
    them to one row per label.  ``kind`` says which set a row belongs to.
    """
    base = df.select(device_group_label().alias("device"), F.col("type"))
    g = (base.groupingSets([["device"], ["type"], []], "device", "type")
             .agg(F.count(F.lit(1)).cast("bigint").alias("events"),
                  F.grouping_id().alias("__g")))
    kind = (F.when(F.col("__g") == 1, F.lit("device")).when(F.col("__g") == 2, F.lit("type"))
             .otherwise(F.lit("total")))
    return g.select(kind.alias("kind"),
                    F.coalesce(F.col("device"), F.col("type"), F.lit("")).alias("key"),
                    "events")


def app_summary(df: DataFrame) -> DataFrame:
    """A3: per non-null app id, event count, last seen ts, sorted distinct platforms."""
    return (df.where(F.col("app_id").isNotNull())
              .groupBy("app_id")
              .agg(F.count(F.lit(1)).cast("bigint").alias("event_count"),
                   F.max("ts").alias("last_seen"),
                   F.array_sort(F.collect_set("platform")).alias("platforms")))


def first_seen(df: DataFrame) -> DataFrame:
    """A4: distinct non-empty device labels and manufacturers with the seq
    where each first appeared (order of the viewer's drop-downs)."""
    dev = (df.select(F.lit("device").alias("kind"), device_label().alias("value"), "seq")
             .where(F.col("value") != ""))
    mfr = (df.select(F.lit("manufacturer").alias("kind"), F.col("device_manufacturer").alias("value"),
                     "seq")
             .where(F.coalesce(F.col("value"), F.lit("")) != ""))
    return (dev.unionByName(mfr).groupBy("kind", "value")
               .agg(F.min("seq").alias("first_seq")))


def batch_sources(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """A5: per batch, the distinct source names (tag, else model), sorted."""
    src = F.when(F.coalesce(F.col("tag"), F.lit("")) != "", F.col("tag")).otherwise(F.col("device_model"))
    return (df.groupBy(batch_col)
              .agg(F.count(F.lit(1)).cast("bigint").alias("events"),
                   F.array_sort(F.collect_set(src)).alias("sources")))


def method_rollup(df: DataFrame) -> DataFrame:
    """Per ``class.method``: event count and count per type."""
    name = F.concat(F.col("class_name"), F.lit("."), F.col("method"))
    return (df.groupBy(name.alias("name"))
              .agg(F.count(F.lit(1)).cast("bigint").alias("events"),
                   *[F.count_if(F.col("type") == t).cast("bigint").alias(t.lower())
                     for t in ("ENTER", "EXIT", "CATCH", "BRANCH")]))


def method_type_sequence(df: DataFrame, chunk_span: int = 1 << 20) -> DataFrame:
    """The type sequence of each ``class.method`` as rows ``(name, pos, seq, type)``.

    ``pos`` (1-based, seq order) comes from a chunked running count, so a
    method holding a large share of all events is numbered by many tasks
    instead of being gathered into one list.  Rows without a class or method
    form the sequence of the null name.
    """
    from calltrail.operators.scan import running_sum

    name = F.concat(F.col("class_name"), F.lit("."), F.col("method"))
    # a struct is a key that is never null itself
    base = df.select(F.struct(name.alias("name")).alias("__key"), "seq", "type", F.lit(1).cast("bigint").alias("__one"))
    out = running_sum(base, ["__key"], "seq", "__one", chunk_span=chunk_span, out="pos")
    return out.select("__key.name", "pos", "seq", "type")


def coverage(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected ``(class_name, method)`` pairs with no events, and
    methods lacking ENTER, EXIT or CATCH.

    ``expected`` is a DataFrame of the methods an app should have traced.
    """
    per = (df.groupBy("class_name", "method")
             .agg(F.count(F.lit(1)).cast("bigint").alias("events"),
                  F.bool_or(F.col("type") == "ENTER").alias("has_enter"),
                  F.bool_or(F.col("type") == "EXIT").alias("has_exit"),
                  F.bool_or(F.col("type") == "CATCH").alias("has_catch")))
    exp = expected.select("class_name", "method").distinct()
    out = exp.join(per, ["class_name", "method"], "left")
    return out.select(
        "class_name", "method",
        F.coalesce(F.col("events"), F.lit(0)).cast("bigint").alias("events"),
        F.col("events").isNull().alias("missing"),
        F.coalesce(~F.col("has_enter"), F.lit(True)).alias("no_enter"),
        F.coalesce(~F.col("has_exit"), F.lit(True)).alias("no_exit"),
        F.coalesce(~F.col("has_catch"), F.lit(True)).alias("no_catch"))
