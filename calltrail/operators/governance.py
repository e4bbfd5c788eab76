"""Deletes and governance on DataFrames: erase a user (D1), quota audit
(D3), repeated batches (D4).  The on-disk forms of D1 / D2 live in
``calltrail.sources.store``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calltrail.schema import STORE_COLUMNS


def erase_user(df: DataFrame, user_id: str) -> DataFrame:
    """Every row except those of ``user_id``; rows without a user stay."""
    if user_id is None:
        raise ValueError("erase_user needs a user id (clearing everything is clear_events)")
    return df.where(~F.col("user_id").eqNullSafe(F.lit(user_id)))


def erased_count(df: DataFrame, user_id: str) -> DataFrame:
    """How many rows the erase removes."""
    return df.agg(F.count_if(F.col("user_id") == F.lit(user_id)).cast("bigint").alias("erased"))


def quota_audit(requests: DataFrame, source_col: str, token_col: str, ts_col: str = "ts",
                source_limit: int = 600, token_limit: int = 10_000,
                window_ms: int = 60_000) -> DataFrame:
    """D3: requests per fixed 60-second bucket per source and per token
    (a missing token counts as ``anon``); a bucket is over quota when its
    count exceeds the limit.  One row per (kind, key, bucket).

    ``requests`` holds one row per ingest request (batch).  Limits are
    arguments; the reference registers 600 per source and 10,000 per token.
    """
    bucket = (F.floor(F.col(ts_col) / F.lit(window_ms)) * F.lit(window_ms)).cast("bigint")
    src = requests.select(F.lit("source").alias("kind"), F.col(source_col).cast("string").alias("key"),
                          bucket.alias("window_start"), F.lit(source_limit).alias("limit"))
    tok = requests.select(F.lit("token").alias("kind"),
                          F.coalesce(F.col(token_col).cast("string"), F.lit("anon")).alias("key"),
                          bucket.alias("window_start"), F.lit(token_limit).alias("limit"))
    g = (src.unionByName(tok).groupBy("kind", "key", "window_start")
            .agg(F.count(F.lit(1)).cast("bigint").alias("requests"), F.max("limit").alias("limit")))
    return g.withColumn("over_limit", F.col("requests") > F.col("limit"))


def wire_fingerprint(columns=None) -> F.Column:
    """Exact identity of an event apart from its store id: its columns as
    one JSON text (maps and arrays included); grouped by its SHA-256."""
    cols = columns or STORE_COLUMNS
    return F.to_json(F.struct(*[F.col(c) for c in cols]))


def repeats(df: DataFrame, columns=None) -> DataFrame:
    """D4 report: per distinct event, the first seq and how many copies."""
    fp = wire_fingerprint(columns)
    return (df.select(F.sha2(fp, 256).alias("__fp"), "seq").groupBy("__fp")
              .agg(F.min("seq").alias("seq"), F.count(F.lit(1)).cast("bigint").alias("copies"))
              .drop("__fp"))


def drop_repeats(df: DataFrame, columns=None) -> DataFrame:
    """Keep the first (lowest seq) copy of each exact repeat.

    Rows are ranked under the SHA-256 of their columns; asking only for the first
    lets Spark keep one row per event in each task before the shuffle (window
    group limit).  Copies that share the lowest seq are reduced to one as well.
    """
    first = F.row_number().over(Window.partitionBy("__fp").orderBy("seq"))
    return (df.withColumn("__fp", F.sha2(wire_fingerprint(columns), 256)).withColumn("__rank", first)
              .where("__rank = 1").drop("__fp", "__rank"))
