"""The query catalogue: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (through the trace view) and runs the
library's operators over all rows.  Maps and arrays are returned as text so
the DuckDB oracle can compare value hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrail import schema as S
from calltrail.functions import masking as M
from calltrail.functions import render as R
from calltrail.operators import calls as C
from calltrail.operators import filters as FL
from calltrail.operators import paging as PG
from calltrail.operators import summary as A
from calltrail.traceview import load_trace

# Fixed query parameters (shared with the oracle SQL).
APP = "com.example.app1"
CURSOR_TS = 1705276800000          # 2024-01-15T00:00:00Z
DAY_3 = 1704240000000              # 2024-01-03T00:00:00Z
DAY_25 = 1706140800000             # 2024-01-25T00:00:00Z
ERASE_USER = "user-8"
BATCH = 50                         # JS client batch size


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_trace(spark, sf_dir)


def _json_map(c) -> F.Column:
    return F.to_json(c)


def q_page(spark, sf_dir):
    """F1 + L1 + P4: first page of one app's CATCH events with detail text."""
    t = trace(spark, sf_dir)
    f = FL.store_query(t, since=0, app_id=APP, level="CATCH")
    p = PG.page(f, limit=100)
    return p.select("seq", "ts", "type", "class_name", "method", "app_id",
                    R.detail().alias("detail"), "page_pos", "next_cursor")


def q_after_cursor(spark, sf_dir):
    """L2: every row after the (ts, seq) cursor."""
    t = trace(spark, sf_dir)
    return PG.after_cursor(t, CURSOR_TS, 0).select("seq", "ts", "type")


def q_viewer_filter(spark, sf_dir):
    """F2 + F3 + F4: viewer filter."""
    t = trace(spark, sf_dir)
    f = FL.viewer_query(t, types=["ENTER", "CATCH"], class_filter="cart", method_filter="LOAD|reduce",
                        manufacturer="google", tag="qa-team", from_ms=DAY_3, to_ms=DAY_25, spark=spark)
    return f.select("seq", "type", "class_name", "method", "tag")


def q_noise_filter(spark, sf_dir):
    """drop generated-code classes (plus a user fragment) and synthetic methods."""
    t = trace(spark, sf_dir)
    return FL.drop_noise(t, extra_fragments=["Repository"]).select("seq", "class_name", "method")


def q_file_exclude(spark, sf_dir):
    """drop rows by file pattern."""
    t = trace(spark, sf_dir)
    return FL.exclude_files(t, patterns=[r"Fragment\.kt$"]).select("seq", "file")


def q_flat_table(spark, sf_dir):
    """The 13-column flat table plus duration text and label."""
    t = trace(spark, sf_dir)
    return t.select(
        "seq", R.date_text().alias("date"), R.time_text().alias("time"), "type", "class_name", "method",
        R.source_ref().alias("file_line"), R.platform_label().alias("platform_label"),
        F.coalesce("app_id", F.lit("")).alias("app"), F.coalesce("user_id", F.lit("")).alias("user"),
        F.col("device_manufacturer").alias("manufacturer"), F.col("device_model").alias("device"), "tag",
        R.detail().alias("detail"), R.format_duration("duration_ms").alias("duration_text"),
        R.device_label().alias("device_label"), R.epoch_sized_duration().alias("epoch_duration"))


def q_detail_text(spark, sf_dir):
    """P3 + P4: detail per event (the extra map rendered per type)."""
    t = trace(spark, sf_dir)
    return t.select("seq", "type", R.detail().alias("detail"),
                    F.to_json(R.extra_map()).alias("extra"))


def q_log_lines(spark, sf_dir):
    """Device-log tag and message per event."""
    t = trace(spark, sf_dir)
    return t.select("seq", R.log_tag().alias("log_tag"), R.log_line().alias("log_line"))


def q_component_class(spark, sf_dir):
    """Component kind per class."""
    t = trace(spark, sf_dir)
    return (t.groupBy("class_name").agg(F.count(F.lit(1)).cast("bigint").alias("events"))
             .select("class_name", R.component_type().alias("component"), "events"))


def _raw_class():
    # Stand-in input: bytecode-style class names built from the view.
    m = F.col("method")
    sfx = (F.when(m == "onCreate", F.lit("$1"))
            .when(m == "reduce", F.concat(F.lit("$$Lambda$"), F.col("line").cast("string")))
            .otherwise(F.concat(F.lit("$"), m)))
    return F.concat(F.lit("com/example/"), F.col("class_name"), sfx)


def q_class_names(spark, sf_dir):
    """Clean bytecode class names."""
    t = trace(spark, sf_dir).select("seq", _raw_class().alias("raw"))
    return t.select("seq", "raw", R.clean_class_name("raw").alias("clean"))


def _raw_method():
    m = F.col("method")
    cap = F.concat(F.upper(F.substring(m, 1, 1)), F.substring(m, 2, 1 << 30))
    c = F.col("class_name")
    return (F.when(c == "LoginViewModel", F.concat(F.lit("get"), cap))
             .when(c == "CheckoutActivity", F.concat(F.lit("set"), cap))
             .when(c == "CartFragment", F.lit("<init>"))
             .when(c == "AuthRepository", F.lit("invokeSuspend"))
             .otherwise(m))


def q_method_names(spark, sf_dir):
    """P20: display names of bytecode method names."""
    t = trace(spark, sf_dir).select("seq", _raw_method().alias("raw"))
    return t.select("seq", "raw", R.clean_method_name("raw").alias("clean"))


def q_mask_params_words(spark, sf_dir):
    """Mask params by key words (default list)."""
    t = trace(spark, sf_dir).where(F.col("params").isNotNull())
    return t.select("seq", F.to_json(M.mask_params_by_words("params")).alias("params"))


def q_mask_params_regex(spark, sf_dir):
    """Mask params by key patterns (default list)."""
    t = trace(spark, sf_dir).where(F.col("params").isNotNull())
    return t.select("seq", F.to_json(M.mask_params_by_regex("params")).alias("params"))


def q_mask_text(spark, sf_dir):
    """Mask secrets in message, result and stack frames."""
    t = trace(spark, sf_dir)
    return t.select("seq", M.mask_text("message").alias("message"), M.mask_text("result").alias("result"),
                    F.array_join(M.mask_text_array("stack"), "\n").alias("stack"))


def q_truncate(spark, sf_dir):
    """Value text cut at 200 (and at 20 for the detail)."""
    t = trace(spark, sf_dir)
    return t.select("seq", R.truncate_value("result").alias("result_text"),
                    R.truncate_value(R.detail(), 20).alias("detail_short"))


def q_stack_frames(spark, sf_dir):
    """Split a raw stack text into trimmed frames."""
    t = trace(spark, sf_dir).where(F.col("stack").isNotNull())
    raw = F.concat(F.lit("  "), F.array_join("stack", " \n\n\t"), F.lit("\n"))
    fr = R.split_stack(raw)
    return t.select("seq", F.array_join(fr, "|").alias("frames"), F.size(fr).cast("int").alias("n_frames"))


def q_conform(spark, sf_dir):
    """v1-shaped rows with empty strings as nulls -> defaults and v2 columns."""
    t = trace(spark, sf_dir)
    v1 = t.select("seq", "type", *[F.nullif(F.col(c), F.lit("")).alias(c) if c in
                                   ("class_name", "method", "thread_name", "device_manufacturer",
                                    "device_model", "tag") else F.col(c)
                                   for c in S.V1_FIELDS if c != "type"])
    c = S.conform(v1)
    return c.select(*[F.to_json(x).alias(x) if x in ("params",) else
                      (F.array_join(x, "\n").alias(x) if x == "stack" else F.col(x))
                      for x in c.columns])


def q_length_check(spark, sf_dir):
    """Declared-width violations (widths tightened for two columns)."""
    t = trace(spark, sf_dir)
    return S.length_violations(t, caps={**S.CAPS, "class_name": 12, "tag": 8})


def q_total(spark, sf_dir):
    """A1."""
    return A.total_count(trace(spark, sf_dir))


def q_stats(spark, sf_dir):
    """A2."""
    return A.stats(trace(spark, sf_dir))


def q_apps(spark, sf_dir):
    """A3 + L4."""
    a = A.app_summary(trace(spark, sf_dir))
    return PG.apps_by_last_seen(a).select("app_id", "event_count", "last_seen",
                                          F.array_join("platforms", ",").alias("platforms"))


def q_first_seen(spark, sf_dir):
    """A4."""
    return A.first_seen(trace(spark, sf_dir))


def q_batch_sources(spark, sf_dir):
    """A5: batches of 50 consecutive events."""
    t = trace(spark, sf_dir).withColumn("batch_id", (F.col("seq") / BATCH).cast("bigint"))
    b = A.batch_sources(t, "batch_id")
    return b.select("batch_id", "events", F.array_join("sources", ",").alias("sources"))


def q_method_rollup(spark, sf_dir):
    """Per-method counts."""
    return A.method_rollup(trace(spark, sf_dir))


def q_method_sequence(spark, sf_dir):
    """Per-method type sequence as rows."""
    return A.method_type_sequence(trace(spark, sf_dir))


def q_coverage(spark, sf_dir):
    """Expected methods (four per traced class) against the events."""
    t = trace(spark, sf_dir)
    expected = (t.select("class_name").distinct()
                 .select("class_name", F.explode(F.array(*[F.lit(m) for m in
                                                           ("onCreate", "reduce", "load", "onResume")]))
                         .alias("method")))
    return A.coverage(t, expected)


def _pairs(scope):
    def q(spark, sf_dir):
        p = C.pair_calls(trace(spark, sf_dir), scope=scope)
        return p.select("scope", "class_name", "method", "enter_seq", "exit_seq", "depth")
    q.__doc__ = f"C1 + C3: ENTER/EXIT pairing, {scope} scope."
    return q


def q_open_calls(spark, sf_dir):
    """Calls never closed (thread scope)."""
    return C.open_calls(trace(spark, sf_dir), "thread").select("scope", "class_name", "method", "seq", "depth")


def q_orphan_exits(spark, sf_dir):
    """Exits that close nothing (thread scope)."""
    return C.orphan_exits(trace(spark, sf_dir), "thread").select("scope", "class_name", "method", "seq")


def _tree(scope):
    def q(spark, sf_dir):
        return C.tree_rows(trace(spark, sf_dir), scope=scope)
    q.__doc__ = f"C4-C6: group tree rows, {scope} scope."
    return q


def q_grouped_table(spark, sf_dir):
    """Grouped table, thread scope."""
    return C.grouped_table(trace(spark, sf_dir), "thread")


def q_call_durations(spark, sf_dir):
    """C1 roll-up: paired / open calls and durations per method (flagship)."""
    return C.call_durations(trace(spark, sf_dir), "thread")


QUERIES = {
    "page": q_page,
    "after_cursor": q_after_cursor,
    "viewer_filter": q_viewer_filter,
    "noise_filter": q_noise_filter,
    "file_exclude": q_file_exclude,
    "flat_table": q_flat_table,
    "detail_text": q_detail_text,
    "log_lines": q_log_lines,
    "component_class": q_component_class,
    "class_names": q_class_names,
    "method_names": q_method_names,
    "mask_params_words": q_mask_params_words,
    "mask_params_regex": q_mask_params_regex,
    "mask_text": q_mask_text,
    "truncate": q_truncate,
    "stack_frames": q_stack_frames,
    "conform": q_conform,
    "length_check": q_length_check,
    "total": q_total,
    "stats": q_stats,
    "apps": q_apps,
    "first_seen": q_first_seen,
    "batch_sources": q_batch_sources,
    "method_rollup": q_method_rollup,
    "method_sequence": q_method_sequence,
    "coverage": q_coverage,
    "call_pairs": _pairs("thread"),
    "call_pairs_class": _pairs("class"),
    "call_pairs_manufacturer": _pairs("manufacturer"),
    "call_pairs_device": _pairs("device"),
    "open_calls": q_open_calls,
    "orphan_exits": q_orphan_exits,
    "tree_thread": _tree("thread"),
    "tree_class": _tree("class"),
    "tree_manufacturer": _tree("manufacturer"),
    "tree_device": _tree("device"),
    "grouped_table": q_grouped_table,
    "call_durations": q_call_durations,
}


# --- governance and sources -------------------------------------------------

from calltrail.operators import governance as G  # noqa: E402
from calltrail.plans import stored  # noqa: E402
from calltrail.plans.stored import batch_texts, log_lines, textify  # noqa: E402
from calltrail.sources import batches as B  # noqa: E402
from calltrail.sources import logs as LG  # noqa: E402


def q_erase_user(spark, sf_dir):
    """D1 on a DataFrame: rows left after erasing one user."""
    return G.erase_user(trace(spark, sf_dir), ERASE_USER).select("seq", "user_id")


def q_decode_batch(spark, sf_dir):
    """Decode JSON-array batch bodies (rendered from the view)."""
    ev, _rej = B.decode_batches(batch_texts(trace(spark, sf_dir)))
    return textify(ev)


def q_decode_log(spark, sf_dir):
    """S3: decode a device log (rendered from the view)."""
    cand = LG.logcat_candidates(log_lines(trace(spark, sf_dir)), "value", "line_no")
    return textify(LG.events_of(cand).drop("source"))


def q_load_report(spark, sf_dir):
    """Loaded / skipped counts of that device log."""
    cand = LG.logcat_candidates(log_lines(trace(spark, sf_dir)), "value", "line_no")
    return LG.load_report(cand)


QUERIES.update({
    "erase_user": q_erase_user,
    "decode_batch": q_decode_batch,
    "decode_log": q_decode_log,
    "load_report": q_load_report,
})


# --- insights ------------------------------------------------------------------

from calltrail.operators import insights as IN  # noqa: E402

RETAIN_FROM = 1705363200000  # 2024-01-16T00:00:00Z


def q_issues(spark, sf_dir):
    """Issues by fingerprint per app."""
    return IN.issues(trace(spark, sf_dir))


def q_alerts(spark, sf_dir):
    """R2: CATCH counts per app in 5-minute windows sliding by 1 minute."""
    return IN.alert_windows(trace(spark, sf_dir), threshold=10)


def q_latency(spark, sf_dir):
    """Exact p50 / p95 / p99 of EXIT durations per method."""
    return IN.latency(trace(spark, sf_dir))


def q_sample(spark, sf_dir):
    """1 % of sessions plus every CATCH."""
    return IN.sample(trace(spark, sf_dir), 1).select("seq", "type", "session_id")


def q_breadcrumbs(spark, sf_dir):
    """The 100 events before each error in its session."""
    return IN.breadcrumbs(trace(spark, sf_dir), 100)


def q_timeline(spark, sf_dir):
    """Last 20 events per user."""
    return IN.timeline(trace(spark, sf_dir), 20).select("user_id", "seq", "type", "rank")


def q_retention(spark, sf_dir):
    """Rows kept by a retention cutoff."""
    return IN.retained(trace(spark, sf_dir), RETAIN_FROM).select("seq")


def _mapping(t: DataFrame) -> DataFrame:
    # Stand-in input: an uploaded mapping table for the minified frames seen.
    fr = t.where(F.col("stack").isNotNull()).select(F.col("source_map_id").alias("map_id"),
                                                     F.explode("stack").alias("frame"))
    return (fr.where(F.col("frame").startswith("at f")).distinct()
              .withColumn("original", F.regexp_replace("frame", r"^at f(\d+)", "at handler$1")))


def q_demap(spark, sf_dir):
    """Stacks rewritten through a mapping table."""
    t = trace(spark, sf_dir)
    d = IN.demap_stacks(t, _mapping(t))
    return d.select("seq", F.array_join("stack", "\n").alias("stack"), "mapped")


QUERIES.update({
    "issues": q_issues,
    "alerts": q_alerts,
    "latency": q_latency,
    "sample": q_sample,
    "breadcrumbs": q_breadcrumbs,
    "timeline": q_timeline,
    "retention": q_retention,
    "demap": q_demap,
})


# --- store round trip, views, live notices ------------------------------------

from calltrail.sources import store as ST  # noqa: E402
from calltrail.streaming.runner import scratch  # noqa: E402

STORE_SINCE = 1704844800000  # 2024-01-10T00:00:00Z
STORE_UNTIL = 1705449600000  # 2024-01-17T00:00:00Z


def q_store_page(spark, sf_dir):
    """S8 + S9 + F1 + L1: the view appended to a day-partitioned store, read
    back with schema evolution, queried with day-partition pruning, paged."""
    table = scratch(spark, "store")
    ST.append_events(trace(spark, sf_dir), table, load_id=1)
    ev = ST.read_events(spark, table)
    f = FL.store_query(ev, since=STORE_SINCE, until=STORE_UNTIL, platform="react-native")
    return PG.page(f, limit=250).select("seq", "ts", "type", "app_id", "page_pos", "next_cursor",
                                        F.col("event_date").cast("string").alias("event_date"))


def q_sort_view(spark, sf_dir):
    """L3: flat view sorted by a shown column (seq breaks ties)."""
    t = trace(spark, sf_dir).select("seq", "class_name", R.detail().alias("detail"))
    return PG.sort_view(t, "detail")


QUERIES.update({
    "store_page": q_store_page,
    "sort_view": q_sort_view,
})


QUERIES.update(stored.QUERIES)
