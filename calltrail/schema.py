"""Canonical event schema (store names), wire names, conform (P1), caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values: (wire name, store column, Spark type, wire default when absent).
# ``None`` default = nullable, no default.  ``type`` has no default (required).
FIELDS = [
    ("type", "type", T.StringType(), None),
    ("class", "class_name", T.StringType(), ""),
    ("method", "method", T.StringType(), ""),
    ("file", "file", T.StringType(), ""),
    ("line", "line", T.IntegerType(), 0),
    ("threadId", "thread_id", T.LongType(), 0),
    ("threadName", "thread_name", T.StringType(), ""),
    ("ts", "ts", T.LongType(), 0),
    ("deviceManufacturer", "device_manufacturer", T.StringType(), ""),
    ("deviceModel", "device_model", T.StringType(), ""),
    ("tag", "tag", T.StringType(), ""),
    ("params", "params", T.MapType(T.StringType(), T.StringType()), None),
    ("result", "result", T.StringType(), None),
    ("durationMs", "duration_ms", T.LongType(), None),
    ("exception", "exception", T.StringType(), None),
    ("message", "message", T.StringType(), None),
    ("tryStartLine", "try_start_line", T.IntegerType(), None),
    ("conditionResult", "condition_result", T.BooleanType(), None),
    ("schemaVersion", "schema_version", T.IntegerType(), None),
    ("platform", "platform", T.StringType(), None),
    ("runtime", "runtime", T.StringType(), None),
    ("appId", "app_id", T.StringType(), None),
    ("appVersion", "app_version", T.StringType(), None),
    ("buildNumber", "build_number", T.StringType(), None),
    ("userId", "user_id", T.StringType(), None),
    ("deviceId", "device_id", T.StringType(), None),
    ("sessionId", "session_id", T.StringType(), None),
    ("stack", "stack", T.ArrayType(T.StringType()), None),
    ("sourceMapId", "source_map_id", T.StringType(), None),
    ("proguardMapId", "proguard_map_id", T.StringType(), None),
    ("isMinified", "is_minified", T.BooleanType(), None),
]

# Declared column widths of the store (characters).
CAPS = {
    "type": 10, "class_name": 500, "method": 200, "file": 300, "thread_name": 200,
    "device_manufacturer": 100, "device_model": 100, "tag": 200, "platform": 32,
    "runtime": 64, "app_id": 200, "app_version": 64, "build_number": 64,
    "user_id": 200, "device_id": 64, "session_id": 64, "source_map_id": 128,
    "proguard_map_id": 128,
}

# The four event types the viewers know.
EVENT_TYPES = ["ENTER", "EXIT", "CATCH", "BRANCH"]

V1_FIELDS = [f[1] for f in FIELDS[:18]]
V2_FIELDS = [f[1] for f in FIELDS[18:]]
WIRE_TO_STORE = {w: s for w, s, _, _ in FIELDS}
STORE_COLUMNS = [s for _, s, _, _ in FIELDS]

EVENT = T.StructType(
    [T.StructField("seq", T.LongType(), True)]
    + [T.StructField(s, t, True) for _, s, t, _ in FIELDS]
)


def _typed(name: str, dtype: T.DataType) -> str:
    if isinstance(dtype, T.StringType):
        return f"cast(`{name}` AS string)"
    return f"try_cast(`{name}` AS {dtype.simpleString()})"


def conform(df: DataFrame, keep_extra: bool = False) -> DataFrame:
    """Fill wire defaults, cast to the store types, add missing v2 columns.

    Works on any frame that holds a subset of the store columns (or already
    typed columns); missing columns appear as null or their wire default.
    """
    # as SQL text: a column made of parts asks the JVM for each of them
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = ["cast(seq AS bigint) AS seq"] if "seq" in types else []
    for _, s, t, default in FIELDS:
        if s not in types:
            c = f"cast(NULL AS {t.simpleString()})"
        else:
            c = f"`{s}`" if types[s] == t else _typed(s, t)
        if default is not None:
            c = f"coalesce({c}, cast('{default}' AS {t.simpleString()}))"
        cols.append(f"{c} AS `{s}`")
    if keep_extra:
        known = {"seq", *STORE_COLUMNS}
        return df.select(*[F.expr(c) for c in cols], *[F.col(c) for c in df.columns if c not in known])
    return df.selectExpr(*cols)


def length_violations(df: DataFrame, caps: dict | None = None) -> DataFrame:
    """One row per (seq, column) whose text exceeds the declared width."""
    caps = CAPS if caps is None else caps
    checks = [
        F.when(F.char_length(F.col(c)) > n,
               F.struct(F.lit(c).alias("column"), F.char_length(F.col(c)).alias("length"),
                        F.lit(n).alias("cap")))
        for c, n in caps.items() if c in df.columns
    ]
    arr = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return (df.select("seq", F.explode(arr).alias("v"))
              .select("seq", "v.column", F.col("v.length").cast("int").alias("length"),
                      F.col("v.cap").cast("int").alias("cap")))


def with_time(df: DataFrame) -> DataFrame:
    """Derived ``event_time`` (timestamp) and ``event_date`` (UTC day) from ``ts`` ms."""
    return df.withColumns({
        "event_time": F.timestamp_millis("ts"),
        "event_date": F.date_from_unix_date(epoch_day(F.col("ts")).cast("int")),
    })


def epoch_day(ts_ms: Column) -> Column:
    """UTC day number of an epoch-ms value, independent of the session zone."""
    return F.floor(ts_ms / F.lit(86_400_000)).cast("bigint")
