"""Second-tier insights described in the reference's design documents:
issues (R1), alert windows (R2), latency percentiles (R3), sampling (R4),
breadcrumbs (R5), timelines (R6), retention filter (R7), stack demapping
(R9), latency anomalies (R10).  Daily partitioning (R8) is the store's.

None of them sends a whole session, method or user to one task: ranks and
trailing statistics come from chunked running sums, neighbourhoods from
bucketed equi-joins, top-N from Spark's per-partition window group limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calltrail.functions.render import EPOCH_SIZED_MS
from calltrail.operators.scan import DEFAULT_CHUNK_SPAN, running_sum

APPROX_ACCURACY = 10_000  # percentile_approx: relative rank error 1 / this


def fingerprint_text(top_frames: int = 5) -> F.Column:
    frames = F.coalesce(F.array_join(F.slice(F.coalesce(F.col("stack"), F.array().cast("array<string>")),
                                             1, top_frames), "\n"), F.lit(""))
    return F.concat(F.coalesce(F.col("exception"), F.lit("")), F.lit("\n"), frames)


def issues(df: DataFrame, top_frames: int = 5) -> DataFrame:
    """CATCH rows grouped by fingerprint = sha256(exception + top frames);
    per (app, fingerprint): first / last seen, events, distinct users."""
    c = df.where(F.col("type") == "CATCH").withColumn("fingerprint", F.sha2(fingerprint_text(top_frames), 256))
    return (c.groupBy("app_id", "fingerprint")
             .agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
                  F.count(F.lit(1)).cast("bigint").alias("events"),
                  F.count_distinct("user_id").cast("bigint").alias("users"),
                  F.min_by("exception", F.col("seq")).alias("exception")))


def alert_windows(df: DataFrame, threshold: int = 10, duration: str = "5 minutes",
                  slide: str = "1 minute", types=("CATCH",)) -> DataFrame:
    """R2: per app, errors in sliding windows; ``alert`` when above ``threshold``."""
    e = df.where(F.col("type").isin(list(types))).withColumn("event_time", F.timestamp_millis("ts"))
    g = (e.groupBy("app_id", F.window("event_time", duration, slide))
          .agg(F.count(F.lit(1)).cast("bigint").alias("events")))
    return g.select("app_id", F.unix_millis(F.col("window.start")).alias("window_start"),
                    F.unix_millis(F.col("window.end")).alias("window_end"), "events",
                    (F.col("events") > threshold).alias("alert"))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, ps=(0.5, 0.95, 0.99),
                      chunk_span: int = DEFAULT_CHUNK_SPAN) -> DataFrame:
    """Exact ``percentile`` (linear interpolation) per key without gathering a
    key's values: count per (key, value), a chunked running count over the
    values gives each value's rank range, and the ranks each percentile
    needs are found by a range test.  Output: keys, ``n``, ``p<100p>``."""
    names, keys = keys, ["__key"]  # a struct of the keys: never null itself, so null keys join
    cnt = df.where(F.col(value).isNotNull()).groupBy(F.struct(*names).alias("__key"), value).agg(
        F.count(F.lit(1)).cast("bigint").alias("__c"))
    cum = running_sum(cnt, keys, value, "__c", chunk_span=chunk_span, out="__cum")
    n = cnt.groupBy(*keys).agg(F.sum("__c").cast("bigint").alias("n"))
    targets = []
    for p in ps:
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.floor(pos) + 1, F.ceil(pos) + 1
        targets.append(F.struct(F.lit(p).alias("p"), F.lit("lo").alias("side"), lo.cast("bigint").alias("rank"),
                                (pos - F.floor(pos)).alias("frac")))
        targets.append(F.struct(F.lit(p).alias("p"), F.lit("hi").alias("side"), hi.cast("bigint").alias("rank"),
                                (pos - F.floor(pos)).alias("frac")))
    t = n.select(*keys, "n", F.inline(F.array(*targets)))
    hit = cum.join(t, keys).where((F.col("rank") > F.col("__cum") - F.col("__c")) & (F.col("rank") <= F.col("__cum")))
    both = (hit.groupBy(*keys, "n", "p", "frac")
               .agg(F.max(F.when(F.col("side") == "lo", F.col(value))).alias("lo"),
                    F.max(F.when(F.col("side") == "hi", F.col(value))).alias("hi")))
    res = both.withColumn("v", F.col("lo") + F.col("frac") * (F.col("hi") - F.col("lo")))
    out = res.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).cast("double")
                                        .alias(f"p{int(round(p * 100))}") for p in ps])
    return out.select(*[F.col("__key")[c].alias(c) for c in names], *[c for c in out.columns if c != "__key"])


def timed_exits(df: DataFrame, max_ms: int | None = None) -> DataFrame:
    """EXITs with a duration, of at most ``max_ms`` where that is given."""
    e = df.where((F.col("type") == "EXIT") & F.col("duration_ms").isNotNull())
    return e if max_ms is None else e.where(F.col("duration_ms") <= F.lit(int(max_ms)))


def cut_durations(df: DataFrame, max_ms: int = EPOCH_SIZED_MS) -> DataFrame:
    """Per method, how many EXITs a limit of ``max_ms`` leaves out (0 rows shown too)."""
    return timed_exits(df).groupBy("class_name", "method").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count_if(F.col("duration_ms") > F.lit(int(max_ms))).cast("bigint").alias("cut"))


def latency(df: DataFrame, ps=(0.5, 0.95, 0.99), exact: bool = True, max_ms: int | None = EPOCH_SIZED_MS) -> DataFrame:
    """Per method, percentiles of EXIT durations; epoch-sized durations
    (duration logging off), above ``max_ms``, are excluded and counted by
    ``cut_durations``.  ``exact=False``: bounded-memory ``percentile_approx``
    sketches instead."""
    e = timed_exits(df, max_ms)
    keys = ["class_name", "method"]
    if exact:
        return exact_percentiles(e, keys, "duration_ms", ps)
    return e.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("n"), *[
        F.percentile_approx("duration_ms", p, APPROX_ACCURACY).cast("double").alias(f"p{int(round(p * 100))}")
        for p in ps])


def rank_check(df: DataFrame, ps=(0.5, 0.95, 0.99), max_ms: int | None = EPOCH_SIZED_MS,
               approx: DataFrame | None = None, error: float = 1 / APPROX_ACCURACY) -> DataFrame:
    """Whether each approximate percentile (of ``latency``, or of `approx`: class_name,
    method, n, p<100p>) keeps its promise: a value whose rank is within
    ``n * error`` (and one row) of ``p * n``."""
    e = timed_exits(df, max_ms)
    approx = latency(df, ps, exact=False, max_ms=max_ms) if approx is None else approx
    names = [f"p{int(round(p * 100))}" for p in ps]
    same = e["class_name"].eqNullSafe(approx["class_name"]) & e["method"].eqNullSafe(approx["method"])
    j = approx.join(e.select("class_name", "method", "duration_ms"), same).select(
        approx["class_name"], approx["method"], "n", *names, "duration_ms")
    ranks = []
    for c in names:
        ranks += [F.count_if(F.col("duration_ms") < F.col(c)).alias(f"__below_{c}"),
                  F.count_if(F.col("duration_ms") <= F.col(c)).alias(f"__upto_{c}")]
    g = j.groupBy("class_name", "method", "n").agg(*ranks)
    slack = F.col("n") * F.lit(error) + 1
    return g.select("class_name", "method", "n", *[
        ((F.col(f"__below_{c}") <= F.lit(float(p)) * F.col("n") + slack)
         & (F.col(f"__upto_{c}") >= F.lit(float(p)) * F.col("n") - slack)).alias(f"{c}_ok")
        for p, c in zip(ps, names)])


def sample_bucket(key: F.Column) -> F.Column:
    """Stable 0..99 bucket of a key: first 32 bits of its md5, modulo 100."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(100))


def sample(df: DataFrame, percent: int = 1, keep_types=("CATCH",)) -> DataFrame:
    """Keep whole sessions whose bucket is under ``percent`` (events with
    no session are sampled one by one), and every event of ``keep_types``."""
    key = F.coalesce(F.col("session_id"), F.col("seq").cast("string"))
    return df.where((sample_bucket(key) < percent) | F.col("type").isin(list(keep_types)))


def breadcrumbs(df: DataFrame, n: int = 100, chunk_span: int = DEFAULT_CHUNK_SPAN) -> DataFrame:
    """For each CATCH, the ``n`` events before it in its session.

    Position in the session comes from a chunked running count; rows are
    bucketed by ``pos div n`` so each error needs at most two buckets, and
    the join key (session, bucket) never holds more than ``n`` rows.
    """
    s = df.where(F.col("session_id").isNotNull()).select(
        "session_id", "seq", "type", "class_name", "method", F.lit(1).cast("bigint").alias("__one"))
    pos = running_sum(s, ["session_id"], "seq", "__one", chunk_span=chunk_span, out="pos").drop("__one")
    pos = pos.withColumn("bucket", F.floor((F.col("pos") - 1) / F.lit(n)).cast("bigint"))
    errs = pos.where(F.col("type") == "CATCH").select(
        "session_id", F.col("seq").alias("err_seq"), F.col("pos").alias("err_pos"))
    lo_b = F.floor((F.greatest(F.col("err_pos") - n, F.lit(1)) - 1) / F.lit(n)).cast("bigint")
    hi_b = F.floor((F.col("err_pos") - 2) / F.lit(n)).cast("bigint")
    want = errs.select("session_id", "err_seq", "err_pos",
                       F.explode(F.array_distinct(F.array(lo_b, hi_b))).alias("bucket"))
    crumbs = (want.join(pos.select("session_id", "bucket", "pos", "type", "class_name", "method"),
                        ["session_id", "bucket"])
                  .where((F.col("pos") < F.col("err_pos")) & (F.col("pos") >= F.col("err_pos") - n)))
    item = F.struct("pos", F.concat(F.col("type"), F.lit(" "), F.col("class_name"), F.lit("."), F.col("method"))
                    .alias("txt"))
    agg = crumbs.groupBy("session_id", "err_seq").agg(F.array_sort(F.collect_list(item)).alias("__l"))
    out = errs.join(agg, ["session_id", "err_seq"], "left")
    lst = F.coalesce(F.transform("__l", lambda x: x["txt"]), F.array().cast("array<string>"))
    return out.select("session_id", F.col("err_seq").alias("seq"), F.size(lst).cast("int").alias("n_crumbs"),
                      F.array_join(lst, "\n").alias("crumbs"))


def timeline(df: DataFrame, n: int = 20, key: str = "user_id") -> DataFrame:
    """The last ``n`` events per user.  The ``row_number() <= n`` filter
    lets Spark keep only ``n`` rows per user in each task before the
    shuffle (window group limit), so a busy user is cut down map-side."""
    w = Window.partitionBy(key).orderBy(F.col("seq").desc())
    return (df.where(F.col(key).isNotNull()).withColumn("rank", F.row_number().over(w))
              .where(F.col("rank") <= n))


def retained(df: DataFrame, cutoff_ms: int) -> DataFrame:
    """R7 on a frame: rows on or after the cutoff day (store: ``drop_before``)."""
    day = F.floor(F.col("ts") / F.lit(86_400_000))
    cond = day >= F.lit(int(cutoff_ms) // 86_400_000)
    if "event_date" in df.columns:
        cond &= F.col("event_date") >= F.date_from_unix_date(F.lit(int(cutoff_ms) // 86_400_000))
    return df.where(cond)


def demap_stacks(df: DataFrame, mapping: DataFrame, id_col: str = "source_map_id") -> DataFrame:
    """Rewrite minified stack frames through a mapping table
    ``(map_id, frame, original)``: explode frames, equi-join on (map id,
    frame), regroup each stack in frame order (one stack per row).  An empty
    stack stays empty; a frame mapped twice takes the least original."""
    fr = df.where(F.col("stack").isNotNull()).select(
        "seq", F.col(id_col).alias("map_id"), F.posexplode_outer("stack").alias("pos", "frame"))
    one = mapping.groupBy("map_id", "frame").agg(F.min("original").alias("original"))
    j = fr.join(one, ["map_id", "frame"], "left")
    g = j.groupBy("seq").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct(
        "pos", F.coalesce(F.col("original"), F.col("frame")).alias("f"))))).alias("__l"),
        F.count("original").cast("int").alias("mapped"))
    return g.select("seq", F.transform("__l", lambda x: x["f"]).alias("stack"), "mapped")


def latency_anomalies(df: DataFrame, k: int = 20, z: float = 3.0,
                      chunk_span: int = DEFAULT_CHUNK_SPAN, bucket_rows: int = 100_000,
                      max_ms: int | None = None) -> DataFrame:
    """Each EXIT duration against the mean and sample deviation of the
    previous ``k`` EXITs of the same method.

    Positions come from a chunked running count.  A method is cut into buckets
    of ``bucket_rows`` positions (``k`` at least), each of which also gets the
    last ``k`` rows of the one before, so a plain trailing window per bucket is
    exact and no method is processed by one task.  ``max_ms`` leaves longer
    durations out (``cut_durations`` counts them); by default all take part.
    """
    size = max(int(bucket_rows), k)
    e = timed_exits(df, max_ms).select(
        F.struct("class_name", "method").alias("__key"),  # a struct is a key that is never null itself
        "seq", F.col("duration_ms").cast("double").alias("x"), F.lit(1).cast("bigint").alias("__one"))
    a = running_sum(e, ["__key"], "seq", "__one", chunk_span=chunk_span, out="pos")
    at, place = F.expr(f"(pos - 1) div {size}"), F.pmod(F.col("pos") - 1, F.lit(size))
    rows = a.select("__key", "seq", "x", "pos", at.alias("__own"), F.explode(
        F.when(place >= size - k, F.array(at, at + 1)).otherwise(F.array(at))).alias("__bucket"))
    w = Window.partitionBy("__key", "__bucket").orderBy("pos").rowsBetween(-k, -1)
    j = rows.withColumns({"__mean": F.avg("x").over(w), "__sd": F.stddev_samp("x").over(w)}).where("__own = __bucket")
    cnt = F.least(F.col("pos") - 1, F.lit(k))
    mean, sd = F.col("__mean"), F.col("__sd")
    return j.select("__key.class_name", "__key.method", "seq", F.col("x").cast("bigint").alias("duration_ms"),
                    F.when(cnt >= 2, F.round(mean, 2)).alias("baseline_mean"),
                    F.when(cnt >= 2, F.round(sd, 2)).alias("baseline_sd"),
                    F.when((cnt >= 2) & (sd > 0), F.abs((F.col("x") - mean) / sd) > F.lit(z)).alias("anomaly"))
