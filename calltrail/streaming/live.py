"""Follow the store (T2, T3) and live views: stats (T5), new-device notices
(T6), call pairing (T7), quota windows (T8), alerts (R2), repeats (D4).

Late rows.  Every view takes all rows, however late they arrive, unless a
``watermark`` is given: then state older than it is freed, and rows later than
it are dropped.  Spark counts those in the query's progress
(``stateOperators[].numRowsDroppedByWatermark``).  ``streaming.rollup`` keeps quota,
alert, usage and latency figures and first copies in tables instead: no state that grows,
and no row too late.
"""

from __future__ import annotations

import datetime
import json
import time

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from calltrail.functions.render import device_label
from calltrail.operators.calls import scope_column
from calltrail.operators.filters import store_query
from calltrail.operators.governance import quota_audit
from calltrail.operators.summary import app_summary, stats
from calltrail.sources import loads as LD
from calltrail.sources.loads import StoreBusy
from calltrail.sources.store import NO_DAY, erasing, file_tag, files_of, read_events


def _adopt(spark: SparkSession, table: str) -> None:
    # files that other writers put into the table (or an erase made of them) get a record each
    root = table.rstrip("/")
    fs, p = LD.fs_of(spark, f"{root}/event_date=*/{{part-,erased-p}}*")
    found = fs.globStatus(p)
    if not found:
        return
    have = set(LD.names_in(spark, f"{root}/_commits"))
    for _, tag, day in files_of(spark, root):
        if tag.startswith("p") and tag not in have:
            LD.put_new(spark, f"{root}/_commits/{tag}", json.dumps({"tag": tag, "days": [day]}))


def commit_stream(spark: SparkSession, table: str, max_loads: int = 1000) -> DataFrame:
    """The store's commit records as a stream (``value``: JSON with the load's
    tag and days): the offset of a follower is the set of loads delivered."""
    fs, p = LD.fs_of(spark, f"{table.rstrip('/')}/_commits")
    fs.mkdirs(p)
    _adopt(spark, table)
    return (spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", str(max_loads))
                 .option("maxFileAge", "36500d").load(f"{table.rstrip('/')}/_commits"))


def rows_of(spark: SparkSession, table: str, records: list[str], wait_s: float = 600.0) -> DataFrame:
    """The rows that the store holds now of some commit records, in whatever
    files: days are pruned, and files by their names.  While an erase exchanges files it
    is waited for."""
    until = time.time() + wait_s
    while erasing(spark, table):
        if time.time() > until:
            raise StoreBusy(f"an erase of {table} has not ended")
        time.sleep(0.2)
    found = [json.loads(r) for r in records]
    days = sorted({d for r in found for d in r["days"]})
    tags = sorted({r["tag"] for r in found})
    dates = [None if d == NO_DAY else datetime.date.fromisoformat(d) for d in days]
    known = F.col("event_date").isin([d for d in dates if d]) if any(dates) else F.lit(False)
    return (read_events(spark, table).where(F.coalesce(known, F.lit(None in dates)))
            .where(file_tag(F.col("_metadata.file_name")).isin(tags)))


def follow(spark: SparkSession, table: str, on_batch, checkpoint: str, compat: bool = False,
           trigger: str = "1500 milliseconds", available_now: bool = False, on_error=None,
           on_connected=None, **filters):
    """Every 1.5 s hand the new store rows matching F1 to ``on_batch(df, epoch)``,
    sorted by (ts, seq).

    T3, ``compat=True``: a row whose ts is not above the highest ts already
    delivered is dropped, as the reference's ts cursor does; the highest ts
    is kept in the checkpoint folder so it survives restarts.  Default: late
    rows are delivered.  ``on_error(exc, epoch)``, when given, receives a
    failure of ``on_batch`` and the stream goes on (that batch counts as
    delivered); without it the failure stops the query.  ``on_connected(query)``
    is called once the stream has started.

    A load is delivered once, with the rows that the store holds of it then: a
    follower that starts or goes on after an erase gets exactly the rows that are left.
    A micro-batch reads the records of at most 1000 loads; their rows stay distributed.
    """
    src = commit_stream(spark, table)
    high_file = f"{checkpoint.rstrip('/')}/_high_ts"

    def _read_high():
        jp = spark._jvm.org.apache.hadoop.fs.Path(high_file)
        fs = jp.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(jp):  # a crash between delete and rename leaves the new file
            jp = spark._jvm.org.apache.hadoop.fs.Path(high_file + ".new")
            if not fs.exists(jp):
                return None
        stream = fs.open(jp)
        try:
            return int(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write_high(v):
        jp = spark._jvm.org.apache.hadoop.fs.Path(high_file)
        fs = jp.getFileSystem(spark._jsc.hadoopConfiguration())
        aside = spark._jvm.org.apache.hadoop.fs.Path(high_file + ".new")
        out = fs.create(aside, True)
        out.write(bytearray(str(v).encode()))
        out.close()
        fs.delete(jp, False)
        if not fs.rename(aside, jp):
            raise OSError(f"could not write {high_file}")

    def run(records: DataFrame, epoch: int):
        df = store_query(rows_of(spark, table, [r["value"] for r in records.collect()]), **filters)
        if compat:
            high = _read_high()
            if high is not None:
                df = df.where(F.col("ts") > F.lit(high))
            m = df.agg(F.max("ts")).first()[0]
        try:
            on_batch(df.orderBy("ts", "seq"), epoch)
        except Exception as exc:  # user callback failed
            if on_error is None:
                raise
            on_error(exc, epoch)
        if compat and m is not None:
            _write_high(max(m, high or m))

    w = src.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    q = w.start()
    if on_connected is not None:
        on_connected(q)
    return q


def _timed(df: DataFrame, watermark: str | None) -> DataFrame:
    d = df.withColumn("event_time", F.timestamp_millis("ts"))
    return d if watermark is None else d.withWatermark("event_time", watermark)


def live_stats(events: DataFrame) -> DataFrame:
    """T5: A2 on a stream (run in update or complete mode)."""
    return stats(events)


def live_apps(events: DataFrame) -> DataFrame:
    """T5: A3 on a stream."""
    return app_summary(events)


def new_labels(events: DataFrame) -> DataFrame:
    """One row the first time a device label or manufacturer appears."""
    dev = events.select(F.lit("device").alias("kind"), device_label().alias("value"), "seq", "ts")
    mfr = events.select(F.lit("manufacturer").alias("kind"), F.col("device_manufacturer").alias("value"),
                        "seq", "ts")
    return dev.unionByName(mfr).where(F.coalesce(F.col("value"), F.lit("")) != "").dropDuplicates(
        ["kind", "value"])


PAIR_SCHEMA = ("scope string, class_name string, method string, kind string, enter_seq long, "
               "exit_seq long, enter_ts long, exit_ts long, duration_ms long")
#: State store that keeps single entries, which live_pairs needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def pairing_session(spark: SparkSession) -> SparkSession:
    """A session beside `spark` (same context, own settings) whose streams keep
    state in RocksDB."""
    own = spark.newSession()
    own.conf.set(_PROVIDER, ROCKSDB)
    return own


class Pairing(StatefulProcessor):
    """Per (scope, class, method): the open ENTERs, one state entry each.

    ``open`` maps a place to an ENTER, ``ends`` says which places [low, top) are
    in use and when the key's timer is due.  The calls that begin and end in one
    micro-batch never reach the state: what is left of it is some EXITs, which each take one entry
    off the top, and then some ENTERs, which each put one on.
    """

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "place long", "seq long, ts long")
        self.ends = handle.getValueState("ends", "low long, top long, due long")

    def close(self) -> None:
        pass

    def _ends(self):
        return tuple(self.ends.get()) if self.ends.exists() else (0, 0, None)

    def _pop(self, low: int, top: int):
        while top > low:
            top -= 1
            if self.open.containsKey((top,)):  # a place may have been left
                entry = self.open.getValue((top,))
                self.open.removeKey((top,))
                return tuple(entry), top
        return None, low

    def _settle(self, low: int, top: int, due) -> None:
        # the timer follows the lowest open ENTER; an empty stack leaves no state
        while low < top and not self.open.containsKey((low,)):
            low += 1
        want = None
        if self.timeout_ms is not None and low < top:
            want = tuple(self.open.getValue((low,)))[1] + self.timeout_ms
        if due != want:
            if due is not None:
                self.handle.deleteTimer(due)
            if want is not None:
                self.handle.registerTimer(want)
        if low < top:
            self.ends.update((low, top, want))
        else:
            self.open.clear()
            self.ends.clear()

    @staticmethod
    def _frame(key, rows):
        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=[c.split()[0] for c in PAIR_SCHEMA.split(", ")])

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        low, top, due = self._ends()
        new, out = [], []
        for typ, seq, ts, dur in zip(pdf["type"], pdf["seq"], pdf["ts"], pdf["duration_ms"]):
            seq, ts = int(seq), int(ts)
            if typ == "ENTER":
                new.append((seq, ts))
                continue
            if new:
                entry = new.pop()
            else:
                entry, top = self._pop(low, top)
            if entry is None:
                out.append(("orphan", None, seq, None, ts, None))
            else:
                out.append(("pair", entry[0], seq, entry[1], ts, None if pd.isna(dur) else int(dur)))
        for entry in new:
            self.open.updateValue((top,), entry)
            top += 1
        self._settle(low, top, due)
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        low, top, due = self._ends()
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if due == now:
            due = None  # this timer is gone
        while low < top:
            if self.open.containsKey((low,)):
                seq, ts = tuple(self.open.getValue((low,)))
                if ts + self.timeout_ms > max(now, timerValues.getCurrentWatermarkInMs()):
                    break
                self.open.removeKey((low,))
                out.append(("open", seq, None, ts, None, None))
            low += 1
        self._settle(low, top, due)
        yield from self._frame(key, out)


def live_pairs(events: DataFrame, scope: str = "thread", watermark: str | None = None,
               timeout_ms: int | None = None) -> DataFrame:
    """Pair ENTER/EXIT as they arrive (append mode).

    State per (scope, class, method) is the stack of open ENTERs, an entry each
    (``Pairing``); rows of a micro-batch are applied in seq order.  By default a call may stay
    open for ever and no row is too late.  ``timeout_ms`` (with a ``watermark``) is the
    longest call tracked: a timer emits the ENTERs that far behind the watermark as
    ``open``, lowest first, and they leave the stack; a key without open calls has no
    state.  The session of `events` needs the RocksDB state store (``pairing_session``).
    """
    if timeout_ms is not None and watermark is None:
        raise ValueError("timeout_ms needs a watermark")
    if events.sparkSession.conf.get(_PROVIDER) != ROCKSDB:
        raise ValueError(f"live_pairs needs {_PROVIDER} = {ROCKSDB}: read the stream in pairing_session(spark)")
    ee = _timed(events.where(F.col("type").isin("ENTER", "EXIT"))
                .select(scope_column(scope).alias("scope"), "class_name", "method", "type", "seq", "ts",
                        "duration_ms"), watermark)
    return ee.groupBy("scope", "class_name", "method").transformWithStateInPandas(
        Pairing(timeout_ms), PAIR_SCHEMA, "append", "None" if timeout_ms is None else "EventTime")


def live_quota(requests: DataFrame, source_col: str, token_col: str, watermark: str | None = None,
               source_limit: int = 600, token_limit: int = 10_000) -> DataFrame:
    """D3 on a stream of requests: 60 s event-time windows, refreshed as
    requests arrive (update mode) or, with a watermark, finalised by it (append mode)."""
    r = _timed(requests, watermark)
    src = r.select(F.lit("source").alias("kind"), F.col(source_col).cast("string").alias("key"), "event_time",
                   F.lit(source_limit).alias("limit"))
    tok = r.select(F.lit("token").alias("kind"), F.coalesce(F.col(token_col).cast("string"), F.lit("anon"))
                   .alias("key"), "event_time", F.lit(token_limit).alias("limit"))
    g = (src.unionByName(tok).groupBy("kind", "key", F.window("event_time", "60 seconds"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("requests"), F.max("limit").alias("limit")))
    return g.select("kind", "key", F.unix_millis(F.col("window.start")).alias("window_start"), "requests",
                    "limit", (F.col("requests") > F.col("limit")).alias("over_limit"))


def live_alerts(events: DataFrame, threshold: int = 10, duration: str = "5 minutes",
                slide: str = "1 minute", watermark: str | None = None, types=("CATCH",)) -> DataFrame:
    """R2 on a stream: errors per app in sliding event-time windows; with a
    watermark the state of a window is freed once it passes the window's end."""
    e = _timed(events.where(F.col("type").isin(list(types))), watermark)
    g = (e.groupBy("app_id", F.window("event_time", duration, slide))
          .agg(F.count(F.lit(1)).cast("bigint").alias("events")))
    return g.select("app_id", F.unix_millis(F.col("window.start")).alias("window_start"),
                    F.unix_millis(F.col("window.end")).alias("window_end"), "events",
                    (F.col("events") > threshold).alias("alert"))


def drop_repeats_live(events: DataFrame, watermark: str | None = None, columns=None) -> DataFrame:
    """D4 on a stream: drop exact repeats (all columns but ``seq``).  The state
    holds a 256-bit fingerprint per event; with a watermark it is freed once
    that passes the event, and only repeats that arrive before then are dropped."""
    from calltrail.operators.governance import wire_fingerprint
    d = _timed(events, watermark).withColumn("__fp", F.sha2(wire_fingerprint(columns), 256))
    d = d.dropDuplicates(["__fp"]) if watermark is None else d.dropDuplicatesWithinWatermark(["__fp"])
    return d.drop("__fp", "event_time")


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = LD.fs_of(spark, path)
    fs.delete(p, True)


def live_rules(spark: SparkSession, table: str, rules: DataFrame, out: str, checkpoint: str,
               statuses: DataFrame | None = None, available_now: bool = False, trigger: str = "10 seconds"):
    """R2 as the store grows: the firings that new loads bring, written to
    ``<out>/batch=<number>``; each is written once.

    A micro-batch judges the issues that occur in its loads, over the days that
    can matter (a window before their first occurrence; for new and reopened all days),
    and leaves out what earlier batches fired: for a count the same occurrence, for a
    new issue any firing of that rule and issue, for a reopened one any after the same
    change.  A replay overwrites its batch.  The store is scanned once for the occurrences of
    those issues, which are kept in ``<out>/_work`` while the batch runs.  Over events that arrive in order of time
    the firings are those of ``rules.firings``.
    """
    from calltrail.operators import rules as RL
    root = out.rstrip("/")
    fired = "rule string, app_id string, fingerprint string, ts long, seq long, kind string, at long, batch long"

    def run(records: DataFrame, epoch: int):
        batch = rows_of(spark, table, [r["value"] for r in records.collect()])
        work = f"{root}/_work/batch={int(epoch)}"
        (RL.occurrences(batch).groupBy("app", "fingerprint").agg(F.min("ts").alias("ts"))
           .write.mode("overwrite").parquet(f"{work}/touched"))
        touched = spark.read.schema("app struct<app_id: string>, fingerprint string, ts long").parquet(f"{work}/touched")
        first = touched.agg(F.min("ts")).first()[0]
        if first is None:
            _drop(spark, work)
            return
        back = rules.where("kind = 'count'").agg(F.max("window_ms")).first()[0] or 0
        # the occurrences of these issues are looked for in the store once
        all_days = RL.occurrences(read_events(spark, table)).join(touched.drop("ts"), ["app", "fingerprint"], "left_semi")
        all_days.write.mode("overwrite").parquet(f"{work}/occurrences")
        every = spark.read.schema(all_days.schema).parquet(f"{work}/occurrences")
        near = every.where(F.col("ts") > F.lit(first - 2 * back))
        none = F.lit(None).cast("long")
        found = (RL.new_issues(every, rules).select("*", F.lit("new").alias("kind"), none.alias("at"))
                 .unionByName(RL.over_count(near, rules).where(F.col("ts") >= F.lit(first))
                              .select("*", F.lit("count").alias("kind"), F.col("seq").alias("at"))))
        if statuses is not None:
            found = found.unionByName(RL.reopened(every, statuses, rules, with_change=True).withColumn("kind", F.lit("reopened")))
        if any(n.startswith("batch=") for n in LD.names_in(spark, root)):
            old = spark.read.schema(fired).parquet(root).where(F.col("batch") < epoch).alias("o")
            n, same = found.alias("n"), ["rule", "app_id", "fingerprint", "kind", "at"]
            found = n.join(old, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in same], "left_anti")
        found.write.mode("overwrite").parquet(f"{root}/batch={int(epoch)}")
        _drop(spark, work)

    w = commit_stream(spark, table).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()


__all__ = ["live_rules", "live_alerts", "drop_repeats_live", "follow", "live_stats", "live_apps", "new_labels", "live_pairs", "live_quota", "quota_audit"]
