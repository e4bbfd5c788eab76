"""Issue status and rule alerts (R1, R2): rules are rows of a table, and each
fires once per change.

An *occurrence* is a CATCH; its issue is (app_id, fingerprint), as in R1.  Status
changes are rows (app_id, fingerprint, ts, status) with status ``resolved``,
``ignored`` or ``unresolved``.  Rules are rows

  rule, kind, app_id (null: every app), threshold, window_ms

new       fires at the first occurrence of an issue
reopened  fires at the first occurrence after an issue was resolved, if none
          of its status changes lies between
count     fires when an issue's occurrences of the last ``window_ms`` (ts - window_ms,
          ts] become more than ``threshold``, and again only after they were not

Occurrences of an issue are ordered by (ts, seq).  A count needs no window over an
issue, which may hold a third of all rows: occurrences get their place in the issue
by a chunked count, and occurrence i is compared with those at the places i - threshold
and i - threshold - 1 by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calltrail.operators.insights import fingerprint_text

RULES_SCHEMA = "rule string, kind string, app_id string, threshold long, window_ms long"
MAX_RULES = 1000
_ISSUE = ["app", "fingerprint"]


def occurrences(df: DataFrame, top_frames: int = 5) -> DataFrame:
    """(app, fingerprint, ts, seq) of the CATCH rows; app is a struct of the app_id,
    so that it is never null in a join."""
    return df.where(F.col("type") == "CATCH").select(
        F.struct("app_id").alias("app"), F.sha2(fingerprint_text(top_frames), 256).alias("fingerprint"), "ts", "seq")


def _placed(occ: DataFrame, span_ms: int) -> DataFrame:
    # place of each occurrence in its issue, counted per stretch of time
    cut = occ.withColumn("chunk", F.floor(F.col("ts") / F.lit(span_ms)))
    own = Window.partitionBy(*_ISSUE, "chunk").orderBy("ts", "seq")
    before = Window.partitionBy(*_ISSUE).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (cut.groupBy(*_ISSUE, "chunk").agg(F.count(F.lit(1)).alias("n"))
              .select(*_ISSUE, "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    return (cut.withColumn("own", F.row_number().over(own)).join(starts, [*_ISSUE, "chunk"])
            .select(*_ISSUE, "ts", "seq", (F.col("start") + F.col("own")).alias("place")))


def _for_apps(rules: DataFrame, kind: str, occ: DataFrame) -> DataFrame:
    """The rules of a kind by app: a rule without an app is one rule of each app
    that has occurrences, so that occurrences meet their rules by key.  A rule table
    is configuration: one of over MAX_RULES rows is refused."""
    rows = rules.where(F.col("kind") == kind).select("rule", "app_id", "threshold", "window_ms").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules of kind {kind}")
    each = "rule string, app struct<app_id: string>, threshold long, window_ms long"
    named = rules.sparkSession.createDataFrame(
        [(r["rule"], (r["app_id"],), r["threshold"], r["window_ms"]) for r in rows if r["app_id"] is not None], each)
    every = [F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["threshold"]).cast("long").alias("threshold"),
                      F.lit(r["window_ms"]).cast("long").alias("window_ms")) for r in rows if r["app_id"] is None]
    if not every:
        return named
    apps = occ.select("app").distinct().select("app", F.explode(F.array(*every)).alias("r"))
    return named.unionByName(apps.select("r.rule", "app", "r.threshold", "r.window_ms"))


def _fired(df: DataFrame, *more: str) -> DataFrame:
    return df.select("rule", F.col("app.app_id").alias("app_id"), "fingerprint", "ts", "seq", *more)


def _first(df: DataFrame, keys: list[str]) -> DataFrame:
    return (df.groupBy(*keys).agg(F.min(F.struct("ts", "seq")).alias("least"))
            .select(*keys, F.col("least.ts").alias("ts"), F.col("least.seq").alias("seq")))


def new_issues(occ: DataFrame, rules: DataFrame) -> DataFrame:
    return _fired(_first(occ, _ISSUE).join(_for_apps(rules, "new", occ), "app"))


def reopened(occ: DataFrame, statuses: DataFrame, rules: DataFrame, with_change: bool = False) -> DataFrame:
    """Each resolved stretch of an issue, from its change (``at``, kept with
    `with_change`) to the next, and the first occurrence in it.  Changes of one
    issue are few; of equal times the last by name counts."""
    s = (statuses.where("ts is not null").groupBy(F.struct("app_id").alias("app"), "fingerprint", F.col("ts").alias("at"))
         .agg(F.max("status").alias("status")))
    s = s.withColumn("until", F.lead("at").over(Window.partitionBy(*_ISSUE).orderBy("at"))).where("status = 'resolved'")
    hit = occ.join(s, _ISSUE).where((F.col("ts") > F.col("at")) & (F.col("until").isNull() | (F.col("ts") <= F.col("until"))))
    first = _first(hit, [*_ISSUE, "at"]).join(_for_apps(rules, "reopened", occ), "app")
    return _fired(first, "at") if with_change else _fired(first)


def over_count(occ: DataFrame, rules: DataFrame, span_ms: int = 3_600_000) -> DataFrame:
    placed = _placed(occ, span_ms)
    own = placed.join(_for_apps(rules, "count", occ), "app")
    for name, back in (("ts_n", F.col("threshold")), ("ts_m", F.col("threshold") + 1)):
        there = placed.select(*_ISSUE, F.col("place").alias("back"), F.col("ts").alias(name))
        own = own.withColumn("back", F.col("place") - back).join(there, [*_ISSUE, "back"], "left").drop("back")
    inside = lambda c: F.coalesce(F.col("ts") - F.col(c) < F.col("window_ms"), F.lit(False))
    return _fired(own.where(inside("ts_n") & ~inside("ts_m")))


def firings(df: DataFrame, rules: DataFrame, statuses: DataFrame | None = None, top_frames: int = 5) -> DataFrame:
    """R2: every firing of the rules over the events: rule, app_id, fingerprint,
    and the occurrence (ts, seq) at which it fired."""
    occ = occurrences(df, top_frames)
    out = new_issues(occ, rules).unionByName(over_count(occ, rules))
    return out if statuses is None else out.unionByName(reopened(occ, statuses, rules))


def issue_status(df: DataFrame, statuses: DataFrame, top_frames: int = 5) -> DataFrame:
    """Per issue its first and last occurrence and its status: that of its last
    change, but ``unresolved`` again once it occurred after being resolved;
    ``unresolved`` if it never changed."""
    occ = occurrences(df, top_frames)
    seen = occ.groupBy(*_ISSUE).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
                                    F.count(F.lit(1)).alias("events"))
    last = (statuses.where("ts is not null").groupBy(F.struct("app_id").alias("app"), "fingerprint")
            .agg(F.max(F.struct("ts", "status")).alias("s")))
    again = (F.col("s.status") == "resolved") & (F.col("last_seen") > F.col("s.ts"))
    status = F.when(F.col("s").isNull() | again, F.lit("unresolved")).otherwise(F.col("s.status"))
    return seen.join(last, _ISSUE, "left").select(F.col("app.app_id").alias("app_id"), "fingerprint", "first_seen",
                                                  "last_seen", "events", status.alias("status"))
