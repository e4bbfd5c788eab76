"""Aggregates that a stream keeps in a table instead of in its state (T5, T8, R1-R3,
D4): any row counts, however late, and the stream itself holds nothing.

A micro-batch is aggregated to one partial row per key and written as a *run* of
its number.  Partial rows of a key from different runs are merged on read, so a
row of a month ago only adds to the partial rows of its own old window.  When
FANOUT runs of one size stand in a row they are merged into one, so a table of n
micro-batches has about FANOUT * log(n) runs and each row is rewritten log(n) times.

A run is a folder ``runs/<first>-<last>/day=...`` and counts from the moment its
record ``done/<first>-<last>`` exists.  A replayed micro-batch whose run or a run
over it is done adds nothing.  Merged runs are removed one merge later, so
readers that began before go on.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltrail.operators.insights import timed_exits
from calltrail.schema import epoch_day
from calltrail.sources import loads as LD

FANOUT = 16


@dataclass(frozen=True)
class Rollup:
    """rows: what of the events counts; keys and parts: columns over those rows
    (``time``, epoch ms, names the one of the keys that decides the day); merge: how the partial
    values of a column are put together; final: columns over the merged ones."""
    keys: dict[str, Column]
    parts: dict[str, Column]
    merge: dict[str, Callable[[str], Column]]
    final: dict[str, Column] = field(default_factory=dict)
    rows: Callable[[DataFrame], DataFrame] = lambda df: df
    time: str = "day_start"

    def partial(self, events: DataFrame) -> DataFrame:
        g = (self.rows(events).groupBy(*[c.alias(k) for k, c in self.keys.items()])
             .agg(*[c.alias(k) for k, c in self.parts.items()]))
        return g.withColumn("day", F.date_from_unix_date(epoch_day(F.col(self.time)).cast("int")))

    def merged(self, partial: DataFrame) -> DataFrame:
        return partial.groupBy("day", *self.keys).agg(*[self.merge[k](k).alias(k) for k in self.parts])

    def finished(self, merged: DataFrame) -> DataFrame:
        return merged.select(*self.keys, *[c.alias(k) for k, c in self.final.items()],
                             *[k for k in self.parts if k not in self.final and not k.startswith("__")])


# --- the runs of a table ----------------------------------------------------------------

def _spans(names: list[str]) -> list[tuple[int, int]]:
    return sorted(tuple(map(int, n.split("-"))) for n in names)


def _cover(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the done runs those that are not inside another."""
    out = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def _done(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    return _spans(LD.names_in(spark, f"{path}/done"))


def _write(df: DataFrame, path: str, span: tuple[int, int]) -> None:
    name = f"{span[0]}-{span[1]}"
    df.write.mode("overwrite").partitionBy("day").parquet(f"{path}/runs/{name}")
    LD.put_new(df.sparkSession, f"{path}/done/{name}", df.drop("day").schema.json())


def _read(spark: SparkSession, path: str, spans) -> DataFrame | None:
    out = None
    for a, b in spans:
        own = T.StructType.fromJson(json.loads(LD.text_of(spark, f"{path}/done/{a}-{b}")))
        df = spark.read.schema(T.StructType(own.fields + [T.StructField("day", T.DateType())])).parquet(f"{path}/runs/{a}-{b}")
        out = df if out is None else out.unionByName(df)
    return out


def _merge(spark: SparkSession, rollup: Rollup, path: str, fanout: int) -> None:
    cover = _cover(_done(spark, path))
    for name in _spans(LD.names_in(spark, f"{path}/runs")):  # superseded by an earlier merge
        if name not in cover and any(a <= name[0] and name[1] <= b for a, b in cover):
            for kind in ("done", "runs"):
                fs, p = LD.fs_of(spark, f"{path}/{kind}/{name[0]}-{name[1]}")
                fs.delete(p, True)
    size = 1
    while True:
        same = [s for s in cover if s[1] - s[0] + 1 == size][:fanout]
        if not any(s[1] - s[0] + 1 >= size for s in cover):
            return
        if len(same) == fanout and same[-1][1] - same[0][0] + 1 == size * fanout:
            span = (same[0][0], same[-1][1])
            _write(rollup.merged(_read(spark, path, same)), path, span)
            cover = sorted([s for s in cover if s not in same] + [span])
        size *= fanout


def add_run(rollup: Rollup, events: DataFrame, path: str, number: int, fanout: int = FANOUT) -> None:
    """Micro-batch `number` of a stream into the table."""
    spark = events.sparkSession
    if not any(a <= number <= b for a, b in _done(spark, path)):
        _write(rollup.partial(events), path, (number, number))
    _merge(spark, rollup, path, fanout)


def keep_rollup(stream: DataFrame, rollup: Rollup, path: str, checkpoint: str, available_now: bool = False,
                trigger: str = "10 seconds", fanout: int = FANOUT):
    """Keep `rollup` of a stream of events up to date in the table at `path`;
    one stream per table, as micro-batch numbers name the runs."""
    root = path.rstrip("/")
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, epoch: add_run(rollup, df, root, int(epoch), fanout)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()


def read_rollup(spark: SparkSession, rollup: Rollup, path: str, since_day: str | None = None, until_day: str | None = None,
                by: list[str] | None = None) -> DataFrame:
    """The rollup as it stands.  Days outside [since_day, until_day] are not
    read; `by` merges further, to those keys alone (a month from its days)."""
    root = path.rstrip("/")
    rows = _read(spark, root, _cover(_done(spark, root)))
    if rows is None:
        raise ValueError(f"no run is done in {path}")
    if since_day is not None:
        rows = rows.where(F.col("day") >= F.lit(since_day).cast("date"))
    if until_day is not None:
        rows = rows.where(F.col("day") <= F.lit(until_day).cast("date"))
    if by is None:
        return rollup.finished(rollup.merged(rows))
    merged = rows.groupBy(*by).agg(*[rollup.merge[k](k).alias(k) for k in rollup.parts])
    return merged.select(*by, *[c.alias(k) for k, c in rollup.final.items()],
                         *[k for k in rollup.parts if k not in rollup.final and not k.startswith("__")])


# --- the rollups of the catalogue -----------------------------------------------------

def _bucket(ms: int) -> Column:
    return (F.floor(F.col("ts") / F.lit(ms)) * F.lit(ms)).cast("bigint")


def quota_rollup(source_col: str, token_col: str, source_limit: int = 600, token_limit: int = 10_000,
                 window_ms: int = 60_000) -> Rollup:
    """D3's quota windows (kind, key, window_start)."""
    def rows(df):
        src = df.select(F.lit("source").alias("kind"), F.col(source_col).cast("string").alias("key"), "ts")
        tok = df.select(F.lit("token").alias("kind"), F.coalesce(F.col(token_col).cast("string"), F.lit("anon")).alias("key"), "ts")
        return src.unionByName(tok)

    limit = F.when(F.col("kind") == "source", F.lit(source_limit)).otherwise(F.lit(token_limit))
    return Rollup(rows=rows, keys={"kind": F.col("kind"), "key": F.col("key"), "window_start": _bucket(window_ms)},
                  parts={"requests": F.count(F.lit(1))}, merge={"requests": F.sum}, time="window_start",
                  final={"requests": F.col("requests"), "limit": limit, "over_limit": F.col("requests") > limit})


def alert_rollup(threshold: int = 10, duration_ms: int = 300_000, slide_ms: int = 60_000, types=("CATCH",)) -> Rollup:
    """R2: errors per app in sliding windows (app_id, window_start)."""
    def rows(df):
        first = _bucket(slide_ms)
        starts = F.sequence(first - F.lit(duration_ms - slide_ms).cast("bigint"), first, F.lit(slide_ms).cast("bigint"))
        return df.where(F.col("type").isin(list(types))).select("app_id", F.explode(starts).alias("window_start"))

    return Rollup(rows=rows, keys={"app_id": F.col("app_id"), "window_start": F.col("window_start")},
                  parts={"events": F.count(F.lit(1))}, merge={"events": F.sum}, time="window_start",
                  final={"window_end": F.col("window_start") + F.lit(duration_ms), "events": F.col("events"),
                         "alert": F.col("events") > threshold})


#: Standard error of the distinct count: 1.04 / sqrt(2^LG_K) = 0.8 %.
HLL_LG_K = 14
#: Rank error of the percentiles: under 0.4 % with 99 % confidence.
KLL_K = 800
DAY_MS = 86_400_000


def usage_rollup() -> Rollup:
    """Per app and day, events, errors and distinct users, mergeable over days."""
    users = F.hll_sketch_agg("user_id", F.lit(HLL_LG_K))
    return Rollup(keys={"app_id": F.col("app_id"), "day_start": _bucket(DAY_MS)},
                  parts={"events": F.count(F.lit(1)), "errors": F.count_if(F.col("type") == "CATCH"), "__users": users},
                  merge={"events": F.sum, "errors": F.sum, "__users": lambda c: F.hll_union_agg(c)},
                  final={"events": F.col("events"), "errors": F.col("errors"), "users": F.hll_sketch_estimate("__users")})


def latency_rollup(ps=(0.5, 0.95, 0.99)) -> Rollup:
    """Per method and day, durations of EXITs as a KLL sketch, mergeable over days."""
    return Rollup(rows=timed_exits,
                  keys={"class_name": F.col("class_name"), "method": F.col("method"), "day_start": _bucket(DAY_MS)},
                  parts={"n": F.count(F.lit(1)), "__d": F.kll_sketch_agg_bigint("duration_ms", F.lit(KLL_K))},
                  merge={"n": F.sum, "__d": lambda c: F.kll_merge_agg_bigint(c)},
                  final={"n": F.col("n"), **{f"p{int(round(p * 100))}": F.kll_sketch_get_quantile_bigint("__d", F.lit(float(p)))
                                             for p in ps}})


# --- exact repeats (D4) ----------------------------------------------------------------

def keep_first(stream: DataFrame, path: str, checkpoint: str, columns=None, available_now: bool = False,
               trigger: str = "10 seconds"):
    """D4 on a stream without state: the events of which no exact copy (all columns
    but ``seq``) was kept before, written to ``<path>/batch=<number>/day=...``.

    Copies have the same ts, so a micro-batch is compared with the kept rows of its
    own days alone (partition pruning), by their 256-bit fingerprints, however
    long ago they came.  Of copies in one micro-batch the least ``seq`` stays.  A
    replayed micro-batch overwrites its own folder and compares with earlier ones only.
    """
    from calltrail.operators.governance import drop_repeats, wire_fingerprint
    root = path.rstrip("/")

    def write(df: DataFrame, epoch: int):
        spark = df.sparkSession
        own = (drop_repeats(df, columns).withColumn("__fp", F.unhex(F.sha2(wire_fingerprint(columns), 256)))
               .withColumn("day", F.date_from_unix_date(epoch_day(F.col("ts")).cast("int"))))
        days = [r["day"] for r in df.select(F.date_from_unix_date(epoch_day(F.col("ts")).cast("int")).alias("day"))
                .distinct().collect()]  # one row per day
        if LD.exists(spark, root):
            schema = T.StructType([T.StructField("__fp", T.BinaryType()), T.StructField("batch", T.LongType()),
                                   T.StructField("day", T.DateType())])
            kept = (spark.read.schema(schema).parquet(root).where(F.col("batch") < epoch)
                    .where(F.col("day").isin(days) | (F.col("day").isNull() if None in days else F.lit(False))).select("__fp"))
            own = own.join(kept.distinct(), "__fp", "left_anti")
        own.write.mode("overwrite").partitionBy("day").parquet(f"{root}/batch={int(epoch)}")

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()


def read_first(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that ``keep_first`` kept; schema: that of its stream."""
    return spark.read.schema(schema).parquet(path.rstrip("/")).select(*[f.name for f in schema.fields])
