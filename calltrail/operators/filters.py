"""Row filters: store query (F1), viewer query (F2), safe regex (F3),
type domain (F4), instrumentation noise (F5), file exclusion (F6)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrail.functions.render import device_label
from calltrail.schema import EVENT_TYPES

MS_PER_DAY = 86_400_000


def store_query(df: DataFrame, since: int = 0, until: int | None = None, platform: str | None = None,
                app_id: str | None = None, user_id: str | None = None, device_id: str | None = None,
                level: str | None = None, tag: str | None = None) -> DataFrame:
    """``ts > since`` (strict), ``ts <= until``, equality on the rest; an
    absent argument is no filter.  On a store partitioned by ``event_date``
    the implied day bounds are added so whole partitions are pruned."""
    cond = F.col("ts") > F.lit(int(since))
    if until is not None:
        cond &= F.col("ts") <= F.lit(int(until))
    for col, val in (("platform", platform), ("app_id", app_id), ("user_id", user_id),
                     ("device_id", device_id), ("type", level), ("tag", tag)):
        if val is not None:
            cond &= F.col(col) == F.lit(val)
    if "event_date" in df.columns:
        lo = F.date_from_unix_date(F.lit(int(since) // MS_PER_DAY))
        cond &= F.col("event_date") >= lo
        if until is not None:
            cond &= F.col("event_date") <= F.date_from_unix_date(F.lit(int(until) // MS_PER_DAY))
    return df.where(cond)


def safe_regex(spark: SparkSession | None, pattern: str | None) -> str | None:
    """blank -> no filter; a pattern Java cannot compile -> literal match.

    The pattern is compiled once on the driver with ``java.util.regex`` (the
    engine that runs ``rlike``); the result is a case-insensitive pattern.
    """
    if pattern is None or pattern.strip() == "":
        return None
    ok = True
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception:
            ok = False
    else:
        try:
            re.compile(pattern)
        except re.error:
            ok = False
    if not ok:
        pattern = r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
    return "(?iu)" + pattern  # folds case beyond ASCII too


def viewer_query(df: DataFrame, types=None, class_filter: str = "", method_filter: str = "",
                 device: str = "", manufacturer: str = "", tag: str = "", from_ms: int = 0,
                 to_ms: int | None = None, spark: SparkSession | None = None) -> DataFrame:
    """F2 (+F4 via ``types``): type in set, class / method regex found
    ignoring case, device label equal, manufacturer equal, tag contains
    ignoring case, ``from_ms <= ts <= to_ms``."""
    spark = spark or df.sparkSession
    types = EVENT_TYPES if types is None else list(types)
    cond = F.col("type").isin(types)
    rc = safe_regex(spark, class_filter)
    if rc:
        cond &= F.col("class_name").rlike(rc)
    rm = safe_regex(spark, method_filter)
    if rm:
        cond &= F.col("method").rlike(rm)
    if device:
        cond &= device_label() == F.lit(device)
    if manufacturer:
        cond &= F.col("device_manufacturer") == F.lit(manufacturer)
    if tag and tag.strip():
        cond &= F.contains(F.lower(F.col("tag")), F.lit(tag.lower()))
    cond &= F.col("ts") >= F.lit(int(from_ms))
    if to_ms is not None:
        cond &= F.col("ts") <= F.lit(int(to_ms))
    return df.where(cond)


def known_types(df: DataFrame) -> DataFrame:
    """keep the four viewer types (the store keeps every type)."""
    return df.where(F.col("type").isin(EVENT_TYPES))


def unknown_type_count(df: DataFrame) -> DataFrame:
    """how many rows a viewer drops."""
    return df.agg(F.count_if(~F.coalesce(F.col("type").isin(EVENT_TYPES), F.lit(False)))
                  .cast("bigint").alias("dropped"))


# Class-name fragments of generated dependency-injection and
# binding code that instrumentation always skips.  The SDK's own package is
# the thirteenth entry; pass it as ``self_package``.
NOISE_CLASS_FRAGMENTS = ["HiltComponents", "Hilt_", "_HiltModules", "hilt_aggregated_deps",
                         "Dagger", "dagger.", "_MembersInjector", "_Factory", "_Impl",
                         "_GeneratedInjector", "databinding.", "BR."]


def noise_condition(extra_fragments=(), self_package: str | None = None) -> Column:
    frags = list(NOISE_CLASS_FRAGMENTS) + list(extra_fragments)
    if self_package:
        frags.append(self_package)
    arr = F.array(*[F.lit(f) for f in frags])
    cls = F.exists(arr, lambda f: F.contains(F.col("class_name"), f))
    m = F.col("method")
    accessor = (F.char_length(m) > 3) & (m.startswith("get") | m.startswith("set")) & \
        F.substring(m, 4, 1).rlike(r"^\p{Lu}$")
    meth = ((m == "<clinit>") | F.contains(m, F.lit("$$")) | m.startswith("access$")
            | m.endswith("$default") | accessor)
    return cls | meth


def drop_noise(df: DataFrame, extra_fragments=(), self_package: str | None = None) -> DataFrame:
    """drop rows of generated classes and synthetic / accessor methods."""
    return df.where(~noise_condition(extra_fragments, self_package))


def file_exclude_condition(patterns=(), runtime_paths=()) -> Column:
    f = F.coalesce(F.col("file"), F.lit(""))
    cond = (f == "") | F.contains(f, F.lit("\u0000")) | F.contains(f, F.lit("/node_modules/"))
    for p in runtime_paths:
        cond = cond | F.contains(f, F.lit(p))
    for p in patterns:
        cond = cond | f.rlike(p)
    return cond


def exclude_files(df: DataFrame, patterns=(), runtime_paths=()) -> DataFrame:
    """drop rows whose ``file`` is missing, virtual (NUL), under
    ``node_modules``, under a runtime path, or matches any user pattern."""
    return df.where(~file_exclude_condition(patterns, runtime_paths))
