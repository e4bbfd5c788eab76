"""Labels and text columns derived from one event row.

Every function takes and returns ``Column`` objects built from
``pyspark.sql.functions``; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "extra_map", "detail", "format_duration", "device_label", "device_group_label",
    "platform_label", "date_text", "time_text", "source_ref", "component_type",
    "truncate_value", "split_stack", "join_stack", "log_line", "log_tag",
    "clean_class_name", "clean_method_name", "epoch_ms_ntz", "epoch_sized_duration",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# The keys the viewer adds to ``extra`` after the params, in order.
EXTRA_FIXED_KEYS = ["result", "durationMs", "exception", "message", "tryStartLine",
                    "conditionResult"]


def extra_map(with_stack: bool = False) -> Column:
    """Params first, then the fixed fields; a fixed field that is set
    replaces a same-named param in place (insertion order kept, like a
    linked map).  ``with_stack`` also adds ``stack`` joined by newlines."""
    fixed = {
        "result": F.col("result"),
        "durationMs": F.col("duration_ms").cast("string"),
        "exception": F.col("exception"),
        "message": F.col("message"),
        "tryStartLine": F.col("try_start_line").cast("string"),
        "conditionResult": F.col("condition_result").cast("string"),
    }
    if with_stack:
        fixed["stack"] = F.array_join(F.col("stack"), "\n")
    params = F.coalesce(F.col("params"), F.create_map().cast("map<string,string>"))

    def over(k, v):
        expr = v
        for name, val in fixed.items():
            expr = F.when(k == F.lit(name), F.coalesce(val, v)).otherwise(expr)
        return expr

    merged = F.transform_values(params, over)
    keys = F.map_keys(params)
    tail = F.filter(
        F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in fixed.items()]),
        lambda e: e["value"].isNotNull() & ~F.array_contains(keys, e["key"]),
    )
    return F.map_concat(merged, F.map_from_entries(tail))


def format_duration(ms) -> Column:
    """P5: ``Xm Ys`` from a minute, ``Xs Yms`` from a second, else ``Xms``."""
    ms = _c(ms)
    return (F.when(ms >= 60_000,
                   F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m "),
                            F.floor((ms % 60_000) / 1000).cast("string"), F.lit("s")))
             .when(ms >= 1_000,
                   F.concat(F.floor(ms / 1000).cast("string"), F.lit("s "),
                            (ms % 1000).cast("string"), F.lit("ms")))
             .otherwise(F.concat(ms.cast("string"), F.lit("ms"))))


def _long_or_zero(s: Column) -> Column:
    # Kotlin toLongOrNull ?: 0 -- an optional sign and digits only.
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint")).otherwise(F.lit(0)).cast("bigint")


def _extra_value(key: str) -> Column:
    """``extra[key]`` for one fixed key without building the map: the field
    when it is set, else a param of the same name (same as ``extra_map``)."""
    field = {
        "result": F.col("result"),
        "durationMs": F.col("duration_ms").cast("string"),
        "exception": F.col("exception"),
        "message": F.col("message"),
        "tryStartLine": F.col("try_start_line").cast("string"),
        "conditionResult": F.col("condition_result").cast("string"),
    }[key]
    return F.coalesce(field, F.col("params").getItem(key))


def detail(extra: Column | None = None) -> Column:
    """The per-type detail text of the ``extra`` map.

    Only ENTER lists the whole map; the other types read single keys, which
    are taken straight from the columns (no map is built for them).
    """
    entries = extra if extra is not None else extra_map()
    get = _extra_value
    enter = F.array_join(
        F.transform(F.map_entries(entries), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "  ")
    exit_ = F.concat(
        F.coalesce(F.concat(F.lit("result: "), get("result"), F.lit("  ")), F.lit("")),
        F.coalesce(F.concat(F.lit("["), format_duration(_long_or_zero(get("durationMs"))), F.lit("]")),
                   F.lit("")),
    )
    catch = F.concat(
        F.coalesce(get("exception"), F.lit("")),
        F.coalesce(F.concat(F.lit(": "), get("message")), F.lit("")),
        F.coalesce(F.concat(F.lit("  (try: line "), get("tryStartLine"), F.lit(" -> catch: line "),
                            F.col("line").cast("string"), F.lit(")")), F.lit("")),
    )
    branch = F.when(F.coalesce(get("conditionResult") == F.lit("true"), F.lit(False)),
                    F.lit("TRUE -- entered if block")).otherwise(F.lit("FALSE -- entered else block"))
    t = F.col("type")
    return (F.when(t == "ENTER", enter).when(t == "EXIT", exit_)
             .when(t == "CATCH", catch).when(t == "BRANCH", branch))


# Fixed value: with duration logging off the start time is 0, so the
# "duration" is the epoch itself; anything above this is such a value.
EPOCH_SIZED_MS = 10 ** 11


def epoch_sized_duration(ms="duration_ms") -> Column:
    """Flag durations that are really epoch timestamps (duration logging off)."""
    return _c(ms) > F.lit(EPOCH_SIZED_MS)


def device_label(tag="tag", model="device_model") -> Column:
    """``model (tag)`` / tag / model / ``""``."""
    tag, model = _c(tag), _c(model)
    has_t = F.coalesce(tag, F.lit("")) != ""
    has_m = F.coalesce(model, F.lit("")) != ""
    return (F.when(has_t & has_m, F.concat(model, F.lit(" ("), tag, F.lit(")")))
             .when(has_t, tag).when(has_m, model).otherwise(F.lit("")))


def device_group_label(tag="tag", model="device_model") -> Column:
    """P6 with ``(unknown)`` for the empty label (server stats, device tree)."""
    lbl = device_label(tag, model)
    return F.when(lbl == "", F.lit("(unknown)")).otherwise(lbl)


# Platform badges.
PLATFORM_LABELS = {"android-jvm": "Android", "react-native": "RN", "ios-swift": "iOS",
                   "web-js": "Web"}


def platform_label(platform="platform") -> Column:
    """Short badge; null and ``""`` give ``""``; unknown values as they are."""
    p = _c(platform)
    expr = F.when(p.isNull() | (p == ""), F.lit(""))
    for k, v in PLATFORM_LABELS.items():
        expr = expr.when(p == k, F.lit(v))
    return expr.otherwise(p)


def epoch_ms_ntz(ts="ts") -> Column:
    """Epoch ms -> TIMESTAMP_NTZ holding the UTC wall clock (session-zone free)."""
    return F.timestamp_add("MILLISECOND", _c(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def _local(ts, zone: str) -> Column:
    utc = epoch_ms_ntz(ts)
    if zone.upper() in ("UTC", "Z", "ETC/UTC", "GMT"):
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def date_text(ts="ts", zone: str = "UTC") -> Column:
    """``yyyy-MM-dd`` of epoch ms in ``zone``."""
    return F.date_format(_local(ts, zone), "yyyy-MM-dd")


def time_text(ts="ts", zone: str = "UTC") -> Column:
    """``HH:mm:ss.SSS`` of epoch ms in ``zone``."""
    return F.date_format(_local(ts, zone), "HH:mm:ss.SSS")


def source_ref(file="file", line="line") -> Column:
    """``file:line``."""
    return F.concat(_c(file), F.lit(":"), _c(line).cast("string"))


def component_type(class_name="class_name") -> Column:
    """ACTIVITY / FRAGMENT / OTHER by class-name suffix."""
    c = _c(class_name)
    return (F.when(c.endswith("Activity"), F.lit("ACTIVITY"))
             .when(c.endswith("Fragment"), F.lit("FRAGMENT")).otherwise(F.lit("OTHER")))


def truncate_value(v, limit: int = 200) -> Column:
    """Null -> ``"null"``; longer than ``limit`` -> first ``limit`` chars + ``...``."""
    v = _c(v).cast("string")
    return (F.when(v.isNull(), F.lit("null"))
             .when(F.char_length(v) > limit, F.concat(F.left(v, F.lit(limit)), F.lit("...")))
             .otherwise(v))


def split_stack(raw) -> Column:
    """Split a raw stack by newline, trim each frame, drop empty frames."""
    parts = F.split(_c(raw), "\n")
    trimmed = F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def join_stack(frames) -> Column:
    """Frames back to one text, newline separated."""
    return F.array_join(_c(frames), "\n")


# The default device-log tag prefix (an argument wherever it is used), the tag
# per event type (EXIT is padded to the others' width) and the tag of
# machine-readable JSON lines.
LOG_TAG_PREFIX = "CallTrail"
LOG_TAGS = {"ENTER": LOG_TAG_PREFIX + " ENTER", "EXIT": LOG_TAG_PREFIX + " EXIT ",
            "CATCH": LOG_TAG_PREFIX + " CATCH", "BRANCH": LOG_TAG_PREFIX + " BRANCH"}
JSON_LOG_TAG = LOG_TAG_PREFIX + " JSON"


def log_tag(prefix: str = LOG_TAG_PREFIX) -> Column:
    """The device-log tag per type; an app's own prefix is an argument."""
    t = F.col("type")
    expr = None
    for k, v in LOG_TAGS.items():
        v = prefix + v[len(LOG_TAG_PREFIX):]
        expr = F.when(t == k, F.lit(v)) if expr is None else expr.when(t == k, F.lit(v))
    return expr


def log_line() -> Column:
    """The human-readable device-log message per type."""
    head = F.concat(F.lit("["), F.col("class_name"), F.lit("] "), F.col("method"))
    src = F.concat(F.lit("src:"), source_ref())
    params = F.col("params")
    param_txt = F.array_join(F.transform(F.map_entries(params),
                                         lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n  ")
    enter = F.concat(head, F.lit("()  "), src,
                     F.when(params.isNotNull(), F.concat(F.lit("\n  "), param_txt)).otherwise(F.lit("")))
    exit_ = F.concat(head, F.lit("  ["), format_duration(F.coalesce(F.col("duration_ms"), F.lit(0))),
                     F.lit("]  "), src,
                     F.coalesce(F.concat(F.lit("\n  result: "), F.col("result")), F.lit("")))
    catch = F.concat(head, F.lit("  "), src, F.lit("\n  try started: line "),
                     F.coalesce(F.col("try_start_line").cast("string"), F.lit("0")),
                     F.lit(" -> catch: line "), F.col("line").cast("string"), F.lit("\n  "),
                     F.coalesce(F.col("exception"), F.lit("Exception")), F.lit(": "),
                     F.coalesce(F.col("message"), F.lit("-")))
    branch = F.concat(head, F.lit("  "), src, F.lit("\n  condition -> "),
                      F.when(F.coalesce(F.col("condition_result"), F.lit(False)),
                             F.lit("TRUE -- entered if block"))
                       .otherwise(F.lit("FALSE -- entered else block")))
    t = F.col("type")
    return (F.when(t == "ENTER", enter).when(t == "EXIT", exit_)
             .when(t == "CATCH", catch).when(t == "BRANCH", branch))


def clean_class_name(name="class_name") -> Column:
    """Last path segment; drop ``$$...``, drop ``$digits``, ``$`` -> ``.``,
    trim dots; empty -> the original segment."""
    simple = F.regexp_extract(_c(name), r"([^/]*)$", 1)
    s = F.regexp_replace(simple, r"\$\$[^$]*", "")
    s = F.regexp_replace(s, r"\$\d+", "")
    s = F.translate(s, "$", ".")
    s = F.regexp_replace(s, r"^\.+|\.+$", "")
    return F.when(s == "", simple).otherwise(s)


def clean_method_name(name="method") -> Column:
    """P20: ``<init>`` -> ``init``, ``getX`` -> ``x``, ``setX`` -> ``x=``,
    ``invokeSuspend`` -> ``{coroutine}``."""
    n = _c(name)
    fourth = F.substring(n, 4, 1)
    accessor = (F.char_length(n) > 3) & fourth.rlike(r"^\p{Lu}$")
    rest = F.concat(F.lower(fourth), F.substring(n, 5, 1 << 30))
    return (F.when(n == "<init>", F.lit("init"))
             .when(n.startswith("get") & accessor, rest)
             .when(n.startswith("set") & accessor, F.concat(rest, F.lit("=")))
             .when(n == "invokeSuspend", F.lit("{coroutine}"))
             .otherwise(n))
