"""Paging and ordering: page (L1), read after a cursor (L2), sort (L3),
app list order (L4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clamp_limit(limit: int | None) -> int:
    return max(1, min(5000, 500 if limit is None else int(limit)))


def page(df: DataFrame, limit: int = 500) -> DataFrame:
    """L1: first ``limit`` rows by (ts, seq), clamped to 1..5000.

    One extra row is fetched to learn whether more follow; ``next_cursor`` is
    the ts of the last kept row when they do (null otherwise), the reference
    server's cursor.  The plan is a single ``TakeOrderedAndProject`` over the
    filtered scan; the window below runs on at most 5001 rows.
    """
    n = clamp_limit(limit)
    probe = df.orderBy("ts", "seq").limit(n + 1)
    w = Window.orderBy("ts", "seq")
    w_all = Window.partitionBy()
    ranked = probe.withColumns({"page_pos": F.row_number().over(w).cast("int"),
                                "__n": F.count(F.lit(1)).over(w_all)})
    last_ts = F.max(F.when(F.col("page_pos") == n, F.col("ts"))).over(w_all)
    out = ranked.withColumn("next_cursor", F.when(F.col("__n") > n, last_ts))
    return out.where(F.col("page_pos") <= n).drop("__n")


def after_cursor(df: DataFrame, cursor_ts: int, cursor_seq: int | None = None,
                 compat: bool = False) -> DataFrame:
    """L2: every row after a saved cursor.

    Default cursor is the pair (ts, seq), which loses no row tied on ``ts``;
    ``compat=True`` keeps the reference's ts-only strict cursor.
    """
    ts = F.col("ts")
    if compat or cursor_seq is None:
        cond = ts > F.lit(int(cursor_ts))
    else:
        cond = (ts > F.lit(int(cursor_ts))) | ((ts == F.lit(int(cursor_ts))) &
                                              (F.col("seq") > F.lit(int(cursor_seq))))
    if "event_date" in df.columns:
        cond &= F.col("event_date") >= F.date_from_unix_date(F.lit(int(cursor_ts) // 86_400_000))
    return df.where(cond)


def next_cursor(df: DataFrame) -> DataFrame:
    """L2: the new cursor = greatest (ts, seq) of what was read."""
    return df.agg(F.max(F.struct("ts", "seq")).alias("c")).select(
        F.col("c.ts").alias("cursor_ts"), F.col("c.seq").alias("cursor_seq"))


def sort_view(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """L3: sort a flat view by any shown column (values compared as shown),
    ``seq`` breaks ties so the order is total."""
    c = F.col(column).asc_nulls_first() if ascending else F.col(column).desc_nulls_last()
    tie = ["seq"] if "seq" in df.columns and column != "seq" else []
    return df.orderBy(c, *tie)


def apps_by_last_seen(apps: DataFrame) -> DataFrame:
    """L4: app list, newest first; app_id breaks ties."""
    return apps.orderBy(F.col("last_seen").desc(), F.col("app_id"))
