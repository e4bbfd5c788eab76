"""The trace view: store-shaped events derived from the driver's ``events`` table.

This only builds input rows in the store schema (FIXTURES.md §2); it does none
of the operators' work.  One SQL text serves Spark and the DuckDB oracle; only
the JSON accessor ``{K}`` and the epoch-millisecond expression ``{MS}`` differ.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACE_SQL = """
WITH k AS (
  SELECT event_id, user_id, event_type, value, {K} AS k, {MS} AS ts_ms FROM {SRC}
), t AS (
  SELECT *,
    CASE event_type WHEN 'click' THEN 'ENTER' WHEN 'view' THEN 'EXIT'
      WHEN 'error' THEN 'CATCH' WHEN 'signup' THEN 'BRANCH'
      ELSE CASE WHEN k % 2 = 0 THEN 'ENTER' ELSE 'EXIT' END END AS type,
    CASE k % 5 WHEN 0 THEN 'LoginViewModel' WHEN 1 THEN 'CheckoutActivity'
      WHEN 2 THEN 'CartFragment' WHEN 3 THEN 'AuthRepository' ELSE 'Cart' END AS class_name,
    CASE user_id % 4 WHEN 0 THEN 'android-jvm' WHEN 1 THEN 'react-native'
      WHEN 2 THEN 'web-js' ELSE NULL END AS platform
  FROM k
)
SELECT
  event_id AS seq,
  type,
  class_name,
  CASE k % 3 WHEN 0 THEN 'onCreate' WHEN 1 THEN 'reduce' ELSE 'load' END AS method,
  concat(class_name, '.kt') AS file,
  CAST(10 + k AS INT) AS line,
  user_id % 4 + 1 AS thread_id,
  CASE WHEN user_id % 4 = 0 THEN 'main' ELSE concat('worker-', CAST(user_id % 4 AS VARCHAR(9))) END AS thread_name,
  ts_ms AS ts,
  CASE user_id % 4 WHEN 0 THEN 'samsung' WHEN 1 THEN 'google' WHEN 2 THEN 'xiaomi' ELSE '' END AS device_manufacturer,
  CASE user_id % 4 WHEN 0 THEN 'SM-G980F' WHEN 1 THEN 'Pixel 7' WHEN 2 THEN 'Mi 9T' ELSE '' END AS device_model,
  CASE user_id % 3 WHEN 0 THEN 'qa-team-1' WHEN 1 THEN 'QA-Team-2' ELSE '' END AS tag,
  CASE WHEN type = 'ENTER' THEN concat('{{"k":"', CAST(k AS VARCHAR(9)),
    '","userPassword":"p', CAST(k AS VARCHAR(9)), '","shipping":"s1"}}') END AS params,
  CASE WHEN type = 'EXIT' AND k % 3 <> 0 THEN concat('ok token=', CAST(k AS VARCHAR(9))) END AS result,
  CASE WHEN type = 'EXIT' THEN CAST(floor(value * 1000) AS BIGINT) END AS duration_ms,
  CASE WHEN type = 'CATCH' THEN CASE k % 3 WHEN 0 THEN 'TypeError'
    WHEN 1 THEN 'NullPointerException' ELSE 'SocketTimeoutException' END END AS exception,
  CASE WHEN type = 'CATCH' THEN CASE k % 4 WHEN 0 THEN 'auth failed: Bearer abc.def'
    WHEN 1 THEN 'password = hunter2 rejected' WHEN 2 THEN 'bad eyJhbGci.eyJzdWIi.c2ln seen' END END AS message,
  CASE WHEN type = 'CATCH' THEN CAST(5 + k AS INT) END AS try_start_line,
  CASE WHEN type = 'BRANCH' THEN value > 10 END AS condition_result,
  CASE WHEN platform IS NOT NULL THEN CAST(2 AS INT) END AS schema_version,
  platform,
  CASE platform WHEN 'android-jvm' THEN 'jvm-34' WHEN 'react-native' THEN 'hermes' WHEN 'web-js' THEN 'node-20' END AS runtime,
  CASE WHEN platform IS NOT NULL THEN concat('com.example.app', CAST(user_id % 5 AS VARCHAR(9))) END AS app_id,
  CASE WHEN platform IS NOT NULL THEN concat('1.0.', CAST(k % 3 AS VARCHAR(9))) END AS app_version,
  CASE WHEN platform IS NOT NULL THEN CAST(k % 7 AS VARCHAR(9)) END AS build_number,
  CASE WHEN platform IS NOT NULL THEN concat('user-', CAST(user_id AS VARCHAR(9))) END AS user_id,
  CASE WHEN platform IS NOT NULL THEN concat('dev-', CAST(user_id AS VARCHAR(9))) END AS device_id,
  CASE WHEN platform IS NOT NULL THEN concat('s-', CAST(user_id AS VARCHAR(9)), '-',
    CAST(CAST(floor(ts_ms / 86400000) AS BIGINT) AS VARCHAR(9))) END AS session_id,
  CASE WHEN type = 'CATCH' AND user_id % 4 IN (1, 2) THEN concat('["at f', CAST(k % 3 AS VARCHAR(9)),
    ' (App.tsx:', CAST(10 + k AS VARCHAR(9)), ':1)","at main (index.js:1:1)"]') END AS stack,
  CASE WHEN platform IN ('react-native', 'web-js') THEN concat('sm-', CAST(k % 3 AS VARCHAR(9))) END AS source_map_id,
  CASE WHEN platform = 'android-jvm' THEN concat('pg-', CAST(k % 3 AS VARCHAR(9))) END AS proguard_map_id,
  CASE WHEN platform IS NOT NULL THEN platform <> 'android-jvm' END AS is_minified
FROM t
"""

DUCK_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
DUCK_MS = "epoch_us(ts) // 1000"
SPARK_K = "CAST(get_json_object(props, '$.k') AS BIGINT)"


def duck_trace_sql(src: str = "events") -> str:
    """The view as DuckDB SQL (params / stack stay JSON text)."""
    return TRACE_SQL.format(K=DUCK_K, MS=DUCK_MS, SRC=src)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store-shaped events (schema ``calltrail.schema.EVENT``) from ``events``."""
    return trace_of(spark, spread(spark, spark.read.parquet(table_path(sf_dir, "events"))))


def spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer splits than the cluster has task
    slots (a small file is one row group, hence one task), so per-row work
    runs in parallel.  A large input already has many splits and is left
    alone, so at scale this adds nothing.  The split count comes from
    physical planning only; no job runs."""
    try:
        slots = spark.sparkContext.defaultParallelism
        n = df._jdf.queryExecution().executedPlan().execute().getNumPartitions()
    except Exception:  # no JVM access (e.g. Spark Connect): leave the scan as is
        return df
    return df.repartition(slots) if n < slots else df


def stream_trace(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The same view over a file-source stream of the ``events`` table."""
    schema = spark.read.parquet(table_path(sf_dir, "events")).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return trace_of(spark, r.parquet(sf_dir))


def trace_of(spark: SparkSession, src: DataFrame) -> DataFrame:
    """Apply the view to an ``events``-shaped frame (batch or streaming).

    The SQL text runs over a temporary view with a name of its own, dropped
    once the query is analysed, so concurrent callers never share a view."""
    ts_type = src.schema["ts"].dataType
    if isinstance(ts_type, T.TimestampNTZType):
        ms = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
    elif isinstance(ts_type, T.TimestampType):
        ms = "unix_millis(ts)"
    else:
        ms = "CAST(ts AS BIGINT)"
    view = f"__calltrail_events_{uuid.uuid4().hex}"
    src.createOrReplaceTempView(view)
    try:
        df = spark.sql(TRACE_SQL.format(K=SPARK_K, MS=ms, SRC=view))
        df.schema  # force analysis while the view exists
    finally:
        spark.catalog.dropTempView(view)
    return df.withColumns({
        "params": F.from_json("params", T.MapType(T.StringType(), T.StringType())),
        "stack": F.from_json("stack", T.ArrayType(T.StringType())),
    })
