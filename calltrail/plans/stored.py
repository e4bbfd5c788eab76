"""Queries over files: bodies, pages, sessions, logs, the store and streams.

Each renders its input files from the trace view (good and bad ones), runs the
library's reader, writer or stream on them and reads the result back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltrail import schema as S
from calltrail.functions import masking as M
from calltrail.functions import render as R
from calltrail.operators import filters as FL
from calltrail.operators import governance as G
from calltrail.operators import insights as IN
from calltrail.operators import rules as RL
from calltrail.sources import batches as B
from calltrail.sources import loads as LD
from calltrail.sources import logs as LG
from calltrail.sources import store as ST
from calltrail.streaming import ingest as IG
from calltrail.streaming import live as LV
from calltrail.streaming import rollup as RU
from calltrail.streaming.runner import append_step, run_append, run_loads, scratch
from calltrail.traceview import load_trace as trace

APP = "com.example.app1"
ERASE_USER = "user-8"
RETAIN_DAY = "2024-01-16"
BATCH = 50           # events of one client batch
FILE_EVENTS = 100    # events of one rendered body or page file
REQUEST_LIMIT = 2    # requests a minute; low enough that the view exceeds it


def textify(df: DataFrame) -> DataFrame:
    """Maps as JSON text, arrays joined by newlines (for the value hash)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.MapType):
            out.append(F.to_json(f.name).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            out.append(F.array_join(f.name, "\n").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# --- stand-in inputs ------------------------------------------------------------

def batch_texts(t: DataFrame, size: int = BATCH) -> DataFrame:
    # each run of `size` events as one JSON array body
    a = (t.withColumn("batch_id", (F.col("seq") / size).cast("bigint"))
          .groupBy("batch_id")
          .agg(F.array_sort(F.collect_list(F.struct("seq", B.wire_json().alias("j")))).alias("a")))
    return a.select("batch_id", F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["j"]), ","),
                                         F.lit("]")).alias("value"))


def log_lines(t: DataFrame) -> DataFrame:
    # a device log with a human line and a JSON line per event
    stamp = F.concat(F.date_format(R.epoch_ms_ntz("ts"), "MM-dd HH:mm:ss.SSS"), F.lit("  1234  "),
                     F.col("thread_id").cast("string"), F.lit(" D "))
    human = F.concat(stamp, R.log_tag(), F.lit(": "), F.split(R.log_line(), "\n").getItem(0))
    js = F.concat(stamp, F.lit(R.JSON_LOG_TAG), F.lit(": "), B.wire_json())
    return t.select(F.explode(F.array(
        F.struct((F.col("seq") * 2).alias("line_no"), human.alias("value")),
        F.struct((F.col("seq") * 2 + 1).alias("line_no"), js.alias("value")))).alias("l")
    ).select("l.line_no", "l.value")


def _write_texts(texts: DataFrame, path: str, gzip_odd: bool = True) -> None:
    # one file per `batch` in one folder, every second one gzipped; tasks write them themselves,
    # as Spark's writer makes a folder per batch and moves it twice
    def write(rows):
        import gzip

        from calltrail.streaming.tail import _open
        system, base = _open(path)
        for n, value, odd in rows:
            data = f"{'' if value is None else value}\n".encode()
            own = f"{base}/batch={'__HIVE_DEFAULT_PARTITION__' if n is None else n}.txt" + (".gz" if odd else "")
            with system.open_output_stream(own, compression=None) as f:
                f.write(gzip.compress(data, 6) if odd else data)

    fs, p = LD.fs_of(texts.sparkSession, path)
    fs.mkdirs(p)
    if gzip_odd:
        texts = texts.where(F.col("batch").isNotNull())
    odd = F.coalesce(F.col("batch") % 2 == 1, F.lit(False)) if gzip_odd else F.lit(False)
    texts.select("batch", "value", odd.alias("odd")).foreachPartition(write)


def _body_files(t: DataFrame, path: str) -> None:
    # of seven bodies one is cut, one holds an event that does not decode, one is no JSON
    b, v = F.col("batch_id") % 7, F.col("value")
    bad = (F.when(b == 3, F.substring(v, 1, 200))
            .when(b == 5, F.concat(F.lit('[{"type":"ENTER","line":"x"},'), F.substring(v, 2, 1 << 30)))
            .when(b == 6, F.lit('[{"type":]')).otherwise(v))
    _write_texts(batch_texts(t, FILE_EVENTS).select(F.col("batch_id").alias("batch"), bad.alias("value")), path)


def _page_files(t: DataFrame, path: str) -> None:
    # old servers' raw arrays, pages, and of nine one answer of another shape
    b, v = F.col("batch_id"), F.col("value")
    page = (F.when(b % 9 == 4, F.lit('{"error":"busy"}')).when(b % 2 == 1, v)
             .otherwise(F.concat(F.lit('{"events":'), v, F.lit(',"nextCursor":null}'))))
    _write_texts(batch_texts(t, FILE_EVENTS).select(b.alias("batch"), page.alias("value")), path, gzip_odd=False)


def _batch_no(col: str) -> F.Column:
    return F.regexp_extract(F.col(col), r"batch=(\d+)", 1).cast("bigint")


def loads(t: DataFrame) -> list[DataFrame]:
    """The view arriving in three loads: threads 1 and 2 in two halves by seq, then
    all the rest, most of it older than what came before."""
    half = t.agg(F.max("seq")).first()[0] // 2
    first = F.coalesce(F.col("thread_id").isin(1, 2), F.lit(False))
    return [t.where(first & (F.col("seq") < half)), t.where(first & (F.col("seq") >= half)), t.where(~first)]


def requests(t: DataFrame) -> DataFrame:
    src = F.coalesce(F.col("device_id"), R.device_group_label())
    return (t.withColumns({"batch_id": (F.col("seq") / BATCH).cast("bigint"), "source": src})
             .groupBy("batch_id", "source")
             .agg(F.min("ts").alias("ts"), F.min_by("app_id", F.col("seq")).alias("token")))


def with_resent(t: DataFrame) -> DataFrame:
    # the react-native clients' events stored twice (their POST replies were
    # lost and the batches retried; the copies get new ids)
    resent = t.where(F.col("platform") == "react-native").withColumn(
        "seq", F.col("seq") + F.lit(1_000_000_000))
    return t.unionByName(resent)


# --- bodies, pages, sessions, logs ------------------------------------------------

def q_bodies(spark, sf_dir):
    """S1 + S2: body files (plain, gzip, bad ones) judged and decoded."""
    path = scratch(spark, "bodies")
    _body_files(trace(spark, sf_dir), path)
    rows = B.read_batch_rows(spark, path)
    good = F.col("reason").isNull()
    return rows.select(_batch_no("batch_id").alias("batch"), "pos",
                       *[F.when(good, F.col(c)).alias(c) for c in ("type", "class_name", "method", "ts")], "reason")


def q_pages(spark, sf_dir):
    """Result pages of both forms, and answers that hold no events."""
    path = scratch(spark, "pages")
    _page_files(trace(spark, sf_dir), path)
    ev, _ = LG.read_pages(spark, path)
    return ev.select(_batch_no("source").alias("page"), F.col("seq").alias("pos"), "type", "class_name", "method", "ts")


def q_session(spark, sf_dir):
    """S10 + S4: the lossless export, loaded again."""
    path = scratch(spark, "session")
    ST.write_session(trace(spark, sf_dir), path)
    ev, _ = LG.read_session(spark, path)
    return textify(ev.drop("source", "seq"))


def q_session_compat(spark, sf_dir):
    """S10 + S4: the viewer's session format (v1 fields, only ``param`` keys)."""
    path = scratch(spark, "compat")
    ST.write_session(trace(spark, sf_dir), path, compat=True)
    ev, _ = LG.read_session(spark, path)
    return textify(ev.select(*S.V1_FIELDS))


def q_read_any(spark, sf_dir):
    """Sessions and device logs in one folder, told apart by their start."""
    path, t = scratch(spark, "mixed"), trace(spark, sf_dir)
    ST.write_session(t.where(F.col("seq") % 2 == 0), f"{path}/sessions", compat=True)
    log_lines(t.where(F.col("seq") % 2 == 1)).select("value").write.text(f"{path}/logs")
    ev, _ = LG.read_any(spark, f"{path}/*")
    return ev.select("kind", "type", "class_name", "method", "ts")


def q_log_stream(spark, sf_dir):
    """T4: device-log files followed as a stream."""
    path = scratch(spark, "log")
    log_lines(trace(spark, sf_dir)).select("value").write.text(path)
    return run_append(spark, IG.logcat_stream(spark, path).select("type", "class_name", "method", "ts"), "log-stream")


def q_log_follow(spark, sf_dir):
    """T4: a folder of device logs that three loads add files to, followed by the
    byte (split every 64 KB) by a stream that starts anew each time."""
    base = scratch(spark, "tail")
    for load in loads(trace(spark, sf_dir)):
        log_lines(load).select("value").write.mode("append").text(f"{base}/log")
        events = IG.logcat_tail(spark, f"{base}/log", pattern="part-*", split_bytes=64 << 10)
        append_step(events.select("type", "class_name", "method", "ts"), base)
    return spark.read.schema("type string, class_name string, method string, ts long").parquet(f"{base}/out")


def q_params_text(spark, sf_dir):
    """Param values of every JSON kind as text."""
    raw = F.concat(F.lit('{"n":'), F.col("line").cast("string"), F.lit(',"b":true,"z":null,"o":{"a":[1,2]},"s":"'),
                   F.col("class_name"), F.lit('"}'))
    m = F.col("m")
    return (trace(spark, sf_dir).select("seq", M.params_from_json(raw).alias("m"))
            .select("seq", *[m[k].alias(k) for k in ("n", "b", "z", "o", "s")]))


# --- the store ----------------------------------------------------------------------

def q_store_erase(spark, sf_dir):
    """D1 on the store: the rows left, and how many went."""
    table = scratch(spark, "erase")
    ST.append_events(trace(spark, sf_dir), table, load_id=1)
    gone = ST.erase_user(spark, table, ERASE_USER)
    return ST.read_events(spark, table).select("seq", "user_id", F.lit(gone).cast("bigint").alias("erased"))


def q_store_clear(spark, sf_dir):
    """Clear a store, then append to it again."""
    table, t = scratch(spark, "clear"), trace(spark, sf_dir)
    ST.append_events(t, table, load_id=1)
    cleared = ST.clear_events(spark, table)
    ST.append_events(t.where(F.col("type") == "CATCH"), table, load_id=1)
    return ST.read_events(spark, table).agg(F.lit(cleared).cast("bigint").alias("cleared"),
                                            F.count(F.lit(1)).cast("bigint").alias("rows"))


def q_store_retention(spark, sf_dir):
    """R7 on the store: days before a date dropped."""
    table = scratch(spark, "retention")
    ST.append_events(trace(spark, sf_dir), table, load_id=1)
    ST.drop_before(spark, table, RETAIN_DAY)
    return ST.read_events(spark, table).select("seq")


def q_store_evolution(spark, sf_dir):
    """Files from before the v2 columns beside newer ones."""
    table, t = scratch(spark, "evolution"), trace(spark, sf_dir)
    old = S.with_time(t.where(F.col("seq") % 2 == 0).select("seq", *S.V1_FIELDS)).drop("event_time")
    old.write.partitionBy("event_date").parquet(table)
    ST.append_events(t.where(F.col("seq") % 2 == 1), table, load_id=1)
    return ST.read_events(spark, table).select("seq", "type", "tag", "platform", "app_id", "session_id", "is_minified")


def q_ingest(spark, sf_dir):
    """Body files streamed into the store, masked; refused batches beside it."""
    base = scratch(spark, "ingest")
    _body_files(trace(spark, sf_dir), f"{base}/in")
    IG.ingest_stream(IG.inbox_session(spark), f"{base}/in", f"{base}/table", f"{base}/ckpt", available_now=True).awaitTermination()
    ev = ST.read_events(spark, f"{base}/table").select("ts", "type", "class_name", "method", "user_id", "message",
                                                       F.lit(None).cast("string").alias("reason"))
    refused = spark.read.schema("batch_id string, reason string").parquet(f"{base}/table_rejected")
    none = F.lit(None)
    return ev.unionByName(refused.select(
        none.cast("bigint").alias("ts"), *[none.cast("string").alias(c) for c in
                                           ("type", "class_name", "method", "user_id", "message")], "reason"))


def q_ingest_two_inboxes(spark, sf_dir):
    """T1 + S8: two inboxes with checkpoints of their own, started anew in between, and
    a user's own load, all into one store; then everything is offered again."""
    base, t = scratch(spark, "inboxes"), trace(spark, sf_dir)
    third = F.col("seq") % 3
    parts = [batch_texts(t.where(third == i), FILE_EVENTS).select(F.col("batch_id").alias("batch"), "value") for i in (0, 1)]

    own = IG.inbox_session(spark)

    def ingest(i, ckpt):
        return IG.ingest_stream(own, f"{base}/in{i}", f"{base}/table", f"{base}/{ckpt}", available_now=True,
                                words=[], key_patterns=[], text_rules=[])

    for i, p in enumerate(parts):
        _write_texts(p, f"{base}/in{i}")
    for _ in range(2):
        streams = [ingest(i, f"ckpt{i}") for i in (0, 1)]
        for s in streams:
            s.awaitTermination()
        ST.append_events(t.where(third == 2).drop("seq"), f"{base}/table", load_id=1)
    return ST.read_events(spark, f"{base}/table").select("ts", "type", "class_name", "method", "user_id", "line")


def q_follow_after_erase(spark, sf_dir):
    """T2 + D1: a follower that lags two loads behind and one that starts anew, after
    a user was erased; both get exactly the rows left, the first none twice."""
    base, parts = scratch(spark, "erased"), loads(trace(spark, sf_dir))
    table = f"{base}/table"

    def follow(name):
        def keep(df, epoch):
            df.select("seq", "ts", "type").write.mode("overwrite").parquet(f"{base}/{name}/epoch={epoch}")
        LV.follow(spark, table, keep, f"{base}/ckpt-{name}", available_now=True).awaitTermination()
        return (spark.read.schema("seq long, ts long, type string").parquet(f"{base}/{name}/epoch=*")
                .withColumn("follower", F.lit(name)))

    ST.append_events(parts[0], table, load_id=1)
    follow("lagging")
    for i, p in enumerate(parts[1:], 2):
        ST.append_events(p, table, load_id=i)
    ST.erase_user(spark, table, ERASE_USER)
    return follow("lagging").unionByName(follow("fresh"))


def _follow(compat: bool):
    def q(spark, sf_dir):
        base = scratch(spark, "follow")

        def keep(df, epoch):
            df.select("seq", "ts", "type").write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

        for i, load in enumerate(loads(trace(spark, sf_dir))):
            ST.append_events(load, f"{base}/table", load_id=i + 1)
            LV.follow(spark, f"{base}/table", keep, f"{base}/ckpt", compat=compat, available_now=True,
                      app_id=APP).awaitTermination()
        return spark.read.schema("seq long, ts long, type string").parquet(f"{base}/out/epoch=*")
    q.__doc__ = ("T3: followed with the reference's rule, rows not above the highest ts delivered are dropped."
                 if compat else "T2: a store followed over three appends, late rows included.")
    return q


# --- live views over three loads ------------------------------------------------------

def _live(view, name, keys=None):
    return lambda spark, sf_dir: run_loads(spark, loads(trace(spark, sf_dir)), view, name, keys)


def q_live_stats(spark, sf_dir):
    """T5: A2 maintained by a stream over three loads (update mode)."""
    return _live(LV.live_stats, "live-stats", ["kind", "key"])(spark, sf_dir)


def q_live_apps(spark, sf_dir):
    """T5: A3 maintained by a stream over three loads (update mode)."""
    out = _live(LV.live_apps, "live-apps", ["app_id"])(spark, sf_dir)
    return out.select("app_id", "event_count", "last_seen", F.array_join("platforms", ",").alias("platforms"))


def q_live_labels(spark, sf_dir):
    """One notice per new device label / manufacturer (three loads)."""
    return _live(LV.new_labels, "live-labels")(spark, sf_dir).select("kind", "value")


def q_live_pairs(spark, sf_dir):
    """Calls paired as their EXIT arrives (stateful stream, three loads)."""
    out = _live(lambda s: LV.live_pairs(s, "thread"), "live-pairs")(LV.pairing_session(spark), sf_dir)
    return out.where(F.col("kind") == "pair").select("scope", "class_name", "method", "enter_seq", "exit_seq")


def q_live_alerts(spark, sf_dir):
    """R2 on a stream: CATCH counts per app in sliding windows (three loads)."""
    return _live(lambda s: LV.live_alerts(s, threshold=10), "live-alerts", ["app_id", "window_start"])(spark, sf_dir)


def q_live_quota(spark, sf_dir):
    """Quota windows over a stream of ingest requests; the last load is older."""
    r = requests(trace(spark, sf_dir))
    third = r.agg(F.max("batch_id")).first()[0] // 3
    b = F.col("batch_id")
    parts = [r.where((b >= third) & (b < 2 * third)), r.where(b >= 2 * third), r.where(b < third)]

    def view(s):
        return LV.live_quota(s, "source", "token", source_limit=REQUEST_LIMIT, token_limit=REQUEST_LIMIT)

    return run_loads(spark, parts, view, "live-quota", ["kind", "key", "window_start"])


def q_live_dedupe(spark, sf_dir):
    """D4 on a stream: retried batches arrive as two later loads, the older last."""
    t = trace(spark, sf_dir)
    resent = with_resent(t).where(F.col("seq") >= F.lit(1_000_000_000))
    half = F.lit(1_000_000_000 + t.agg(F.max("seq")).first()[0] // 2)
    parts = [t, resent.where(F.col("seq") >= half), resent.where(F.col("seq") < half)]
    return run_loads(spark, parts, LV.drop_repeats_live, "live-dedupe").select(
        "ts", "type", "class_name", "method", "user_id")


# --- figures kept in tables, late rows included -----------------------------------------

def _rollup(spark, parts, rollup, name, **read):
    base = scratch(spark, name)
    for part in parts:  # a load is a micro-batch; pairs of runs are merged
        part.write.mode("append").parquet(f"{base}/in")
        RU.keep_rollup(spark.readStream.schema(part.schema).parquet(f"{base}/in"), rollup, f"{base}/table", f"{base}/ckpt",
                       available_now=True, fanout=2).awaitTermination()
    return RU.read_rollup(spark, rollup, f"{base}/table", **read)


def q_late_quota(spark, sf_dir):
    """Quota windows kept in a table; the last load is older than the others."""
    r = requests(trace(spark, sf_dir))
    third, b = r.agg(F.max("batch_id")).first()[0] // 3, F.col("batch_id")
    parts = [r.where((b >= third) & (b < 2 * third)), r.where(b >= 2 * third), r.where(b < third)]
    return _rollup(spark, parts, RU.quota_rollup("source", "token", REQUEST_LIMIT, REQUEST_LIMIT), "late-quota")


def q_late_alerts(spark, sf_dir):
    """R2: alert windows kept in a table over three loads."""
    return _rollup(spark, loads(trace(spark, sf_dir)), RU.alert_rollup(threshold=10), "late-alerts")


def q_late_dedupe(spark, sf_dir):
    """First copies kept in a table; retried batches arrive as later loads."""
    t, base = trace(spark, sf_dir), scratch(spark, "late-dedupe")
    resent = with_resent(t).where(F.col("seq") >= F.lit(1_000_000_000))
    for part in [*loads(t), resent]:
        part.write.mode("append").parquet(f"{base}/in")
        RU.keep_first(spark.readStream.schema(t.schema).parquet(f"{base}/in"), f"{base}/table", f"{base}/ckpt",
                      available_now=True).awaitTermination()
    return RU.read_first(spark, f"{base}/table", t.schema).select("ts", "type", "class_name", "method", "user_id")


def q_usage_days(spark, sf_dir):
    """Events, errors and distinct users per app over all days, from daily
    sketches; users_ok: within 4 standard errors of the exact count."""
    t = trace(spark, sf_dir)
    got = _rollup(spark, loads(t), RU.usage_rollup(), "usage", by=["app_id"]).alias("g")
    exact = t.groupBy("app_id").agg(F.countDistinct("user_id").alias("n")).alias("x")
    off = F.abs(F.col("users") - F.col("n")) <= F.col("n") * F.lit(4 * 1.04 / 2 ** (RU.HLL_LG_K / 2))
    return got.join(exact, F.col("g.app_id").eqNullSafe(F.col("x.app_id"))).select(
        "g.app_id", "events", "errors", off.alias("users_ok"))


def q_latency_days(spark, sf_dir):
    """p50, p95 and p99 per method over all days, from daily sketches: each is a
    value whose rank is within 0.8 % of what it should be."""
    t = trace(spark, sf_dir)
    got = _rollup(spark, loads(t), RU.latency_rollup(), "latency-days", by=["class_name", "method"])
    return IN.rank_check(t, max_ms=None, approx=got, error=0.008)


# --- issues and rules ---------------------------------------------------------------------

def _rules(spark):
    return spark.createDataFrame([("any-new", "new", None, None, None), ("back-again", "reopened", None, None, None),
                                  ("burst", "count", None, 2, 6 * 3_600_000), ("app-burst", "count", APP, 4, 86_400_000)],
                                 "rule string, kind string, app_id string, threshold long, window_ms long")


def _resolved(t):
    # every issue is resolved halfway between its first and its last occurrence, and every second ignored a day later
    i = IN.issues(t).withColumn("at", ((F.col("first_seen") + F.col("last_seen")) / 2).cast("bigint"))
    own = i.select("app_id", "fingerprint", F.col("at").alias("ts"), F.lit("resolved").alias("status"))
    return own.unionByName(i.where(F.col("events") % 2 == 0).select(
        "app_id", "fingerprint", (F.col("at") + 86_400_000).alias("ts"), F.lit("ignored").alias("status")))


def q_rule_alerts(spark, sf_dir):
    """R2: new and reopened issues and counts over limits, each fired once per change."""
    t = trace(spark, sf_dir)
    return RL.firings(t, _rules(spark), _resolved(t))


def q_issue_status(spark, sf_dir):
    """The status of every issue after its changes and occurrences."""
    t = trace(spark, sf_dir)
    return RL.issue_status(t, _resolved(t))


def q_live_rules(spark, sf_dir):
    """R2 on the store as it grows by three loads in order of time."""
    base, t = scratch(spark, "rules"), trace(spark, sf_dir)
    low, high = t.agg(F.min("ts"), F.max("ts")).first()
    _resolved(t).write.parquet(f"{base}/statuses")  # each load asks for them
    rules, statuses = _rules(spark), spark.read.schema("app_id string, fingerprint string, ts long, status string").parquet(f"{base}/statuses")
    for i in range(3):
        a, b = (low + (high - low) * k // 3 for k in (i, i + 1))
        ST.append_events(t.where((F.col("ts") >= a) & ((F.col("ts") < b) | F.lit(i == 2))), f"{base}/table", load_id=i)
        LV.live_rules(spark, f"{base}/table", rules, f"{base}/out", f"{base}/ckpt", statuses,
                      available_now=True).awaitTermination()
    return spark.read.schema("rule string, app_id string, fingerprint string, ts long, seq long").parquet(f"{base}/out/batch=*")


def q_tree_window(spark, sf_dir):
    """500 rows of the grouped table from row 3,000 on."""
    from calltrail.operators.calls import grouped_table, window_of_rows
    rows = window_of_rows(grouped_table(trace(spark, sf_dir), "device"), 3000, 500, chunk_span=1 << 10)
    return rows.select("pos", "level", "kind", "label", "date", "time", "type", "detail")


# --- rules on rows that meet them --------------------------------------------------------

def q_unknown_types(spark, sf_dir):
    """rows a viewer drops because their type is not one of the four."""
    t = trace(spark, sf_dir).withColumn("type", F.when(F.col("seq") % 10 == 0, F.lit("CUSTOM"))
                                        .when(F.col("seq") % 10 == 1, F.lit(None)).otherwise(F.col("type")))
    return FL.unknown_type_count(t)


def q_regex_literal(spark, sf_dir):
    """a pattern that does not compile is searched as it stands, ignoring case."""
    t = trace(spark, sf_dir).withColumn("class_name", F.when(
        F.col("seq") % 3 == 0, F.concat(F.col("class_name"), F.lit("(1)"))).otherwise(F.col("class_name")))
    return FL.viewer_query(t, class_filter="cart(").select("seq", "class_name")


def q_noise_builtin(spark, sf_dir):
    """the built-in fragments and method rules alone."""
    c, m, k = F.col("class_name"), F.col("method"), F.col("seq") % 6
    cls = (F.when(k == 0, F.concat(F.lit("Hilt_"), c)).when(k == 1, F.concat(c, F.lit("_Factory"))).otherwise(c))
    meth = (F.when(k == 2, F.lit("<clinit>")).when(k == 3, F.concat(F.lit("get"), F.initcap(m)))
             .when(k == 4, F.concat(F.lit("get"), m)).otherwise(m))
    t = trace(spark, sf_dir).select("seq", cls.alias("class_name"), meth.alias("method"))
    return FL.drop_noise(t)


def q_quota_audit(spark, sf_dir):
    """D3: ingest requests per 60 s bucket per source and per token."""
    return G.quota_audit(requests(trace(spark, sf_dir)), "source", "token", "ts",
                         source_limit=REQUEST_LIMIT, token_limit=REQUEST_LIMIT)


def q_drop_repeats(spark, sf_dir):
    """Exact repeats from retried batches dropped."""
    return G.drop_repeats(with_resent(trace(spark, sf_dir))).select("seq", "ts", "type")


def q_repeats(spark, sf_dir):
    """Exact repeats from retried batches: first seq and copy count."""
    return G.repeats(with_resent(trace(spark, sf_dir)))


def _uneven(t: DataFrame) -> DataFrame:
    # some calls take 50 times as long, some log an epoch time for a duration
    k = F.col("seq") % 97
    return t.withColumn("duration_ms", F.when(k == 5, F.col("duration_ms") * 50)
                        .when(k == 6, F.col("duration_ms") + F.lit(1_700_000_000_000)).otherwise(F.col("duration_ms")))


def q_anomalies(spark, sf_dir):
    """EXIT durations against the previous 20 of the same method, epoch-sized ones left out."""
    return IN.latency_anomalies(_uneven(trace(spark, sf_dir)), k=20, max_ms=R.EPOCH_SIZED_MS)


def q_latency_cut(spark, sf_dir):
    """How many durations the epoch-size limit leaves out, per method."""
    return IN.cut_durations(_uneven(trace(spark, sf_dir)))


def q_latency_approx(spark, sf_dir):
    """R3 with bounded-memory sketches: each percentile's rank is within its bound."""
    return IN.rank_check(trace(spark, sf_dir))


QUERIES = {
    "bodies": q_bodies, "pages": q_pages, "session": q_session, "session_compat": q_session_compat,
    "read_any": q_read_any, "log_stream": q_log_stream, "params_text": q_params_text,
    "store_erase": q_store_erase, "store_clear": q_store_clear, "store_retention": q_store_retention,
    "store_evolution": q_store_evolution, "ingest": q_ingest, "follow": _follow(False),
    "follow_compat": _follow(True), "ingest_two_inboxes": q_ingest_two_inboxes,
    "follow_after_erase": q_follow_after_erase, "log_follow": q_log_follow, "late_quota": q_late_quota,
    "late_alerts": q_late_alerts, "late_dedupe": q_late_dedupe, "usage_days": q_usage_days,
    "latency_days": q_latency_days, "rule_alerts": q_rule_alerts, "issue_status": q_issue_status,
    "live_rules": q_live_rules, "tree_window": q_tree_window, "live_stats": q_live_stats, "live_apps": q_live_apps,
    "live_labels": q_live_labels, "live_pairs": q_live_pairs, "live_alerts": q_live_alerts,
    "live_quota": q_live_quota, "live_dedupe": q_live_dedupe, "unknown_types": q_unknown_types,
    "regex_literal": q_regex_literal, "noise_builtin": q_noise_builtin, "quota_audit": q_quota_audit,
    "drop_repeats": q_drop_repeats, "repeats": q_repeats, "anomalies": q_anomalies,
    "latency_cut": q_latency_cut, "latency_approx": q_latency_approx,
}
