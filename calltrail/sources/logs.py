"""Viewer inputs: device logs (S3), saved sessions (S4), format detection
(S5), result pages (S6) and the load report (S7).

Each reader first builds *candidates* (one row per array element or per log
line that mentions the JSON tag) with an ``ok`` flag; ``events`` are the ok
rows and ``load_report`` counts both.  Everything is column expressions;
a file is one row only for pages (S6) and arrays that are not plain ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltrail.functions.render import JSON_LOG_TAG, LOG_TAG_PREFIX
from calltrail.schema import EVENT_TYPES, FIELDS
from calltrail.sources import arrays as AR
from calltrail.sources.batches import _flat_json

_MAP = T.MapType(T.StringType(), T.StringType())
_ARR = T.ArrayType(_MAP)
_PAGE = T.StructType([T.StructField("events", _ARR, True)])


def _event_cols(e: Column, nulls_fail: bool = False) -> tuple[list[Column], Column]:
    """Store columns from a map of raw JSON values, and whether it is valid.

    Unknown types are not valid; a present value that does not decode
    (e.g. ``"line": "x"``, or a param whose value is an object or null) is
    not valid; missing values take their default (``ts`` 0, never "now").
    An explicit null of a field with a default takes the default too (saved
    sessions, pages), or is not valid with ``nulls_fail`` (device logs).
    """
    cols, ok = [], e.getItem("type").isin(EVENT_TYPES)
    for w, s, dt, d in FIELDS:
        raw = e.getItem(w)
        if isinstance(dt, (T.MapType, T.ArrayType)):
            # values must be scalars (the viewer reads each as a string)
            c = F.from_json(raw, dt)
            ok = ok & (raw.isNull() | (raw == "null") | (c.isNotNull() & _flat_json(raw)))
        elif isinstance(dt, T.StringType):
            c = raw
        else:
            c = raw.try_cast(dt)
            ok = ok & (raw.isNull() | (raw == "null") | c.isNotNull())
        if d is not None:
            if nulls_fail:
                ok = ok & ~(F.map_contains_key(e, F.lit(w)) & raw.isNull())
            c = F.coalesce(c, F.lit(d).cast(dt))
        cols.append(c.alias(s))
    return cols, F.coalesce(ok, F.lit(False))


def logcat_candidates(lines: DataFrame, text_col: str = "value", order_col: str | None = None,
                      file_col: str | None = None) -> DataFrame:
    """S3 candidates from a frame of log lines.

    Keeps lines containing the JSON log tag, decodes from the first ``{``.
    Also counts every line containing the tag prefix for the load report.
    """
    v = F.col(text_col)
    seq = F.col(order_col) if order_col else F.monotonically_increasing_id()
    src = F.col(file_col) if file_col else F.lit("")
    base = lines.select(src.alias("source"), seq.cast("bigint").alias("seq"), v.alias("__v"))
    base = base.where(F.contains(F.col("__v"), F.lit(LOG_TAG_PREFIX)))
    is_json = F.contains(F.col("__v"), F.lit(JSON_LOG_TAG)) & (F.instr(F.col("__v"), "{") > 0)
    body = F.substring(F.col("__v"), F.instr(F.col("__v"), "{"), 1 << 30)
    e = F.when(is_json, F.from_json(body, _MAP))
    cols, ok = _event_cols(F.col("__e"), nulls_fail=True)
    return (base.withColumns({"__e": e, "__json": is_json})
                .select("source", "seq", F.col("__json").alias("candidate"),
                        (F.col("__json") & F.col("__e").isNotNull() & ok).alias("ok"), *cols))


def read_logcat(spark: SparkSession, path: str):
    """S3: device-log text -> (events, candidates)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value",
                                         F.monotonically_increasing_id().alias("line_no"))
    cand = logcat_candidates(lines, "value", "line_no", "file")
    return events_of(cand), cand


def _session_rows(rows: DataFrame) -> DataFrame:
    # (source, pos, __e): one raw element each
    cols, ok = _event_cols(F.col("__e"))
    return rows.select("source", F.col("pos").cast("bigint").alias("seq"), F.lit(True).alias("candidate"),
                       (F.col("__e").isNotNull() & ok).alias("ok"), *cols)


def array_candidates(texts: DataFrame, id_col: str = "source", text_col: str = "value") -> DataFrame:
    """S4 candidates: one row per element of each text's JSON array."""
    ex = texts.select(F.col(id_col).alias("source"), F.posexplode(F.from_json(F.col(text_col), _ARR))
                      .alias("pos", "__e"))
    return _session_rows(ex)


def line_candidates(lines: DataFrame) -> DataFrame:
    """S4 candidates of a JSON-lines session (the lossless export of
    ``write_session``): one row per non-blank line of (source, line_no, value)."""
    return _session_rows(lines.where(F.trim("value") != "")
                         .select("source", F.col("line_no").alias("pos"), F.from_json("value", _MAP).alias("__e")))


def _lines(spark: SparkSession, paths) -> DataFrame:
    """Text lines (source, line_no, value) in file order; splittable files are
    read by many tasks."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("source"),
                                         F.monotonically_increasing_id().alias("line_no"), "value")


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """Per file, its first text that is not blank, cut to one character.  Lines are
    aggregated map-side to one row per file and split of it."""
    seen = (spark.read.text(path).where(F.col("value").rlike(r"\S"))
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                    F.monotonically_increasing_id().alias("n"),
                    F.regexp_extract("value", r"(\S)", 1).alias("head")))
    return seen.groupBy("file").agg(F.min_by("head", F.struct("at", "n")).alias("head"))


def _by_start(spark: SparkSession, path: str):
    """The files under ``path`` that start with ``[`` (JSON arrays, read by
    element) and the others (read by line).  One path per file comes to the
    driver, as in any listing."""
    arrays, others = [], []
    for r in _starts(spark, path).collect():
        (arrays if r["head"] == "[" else others).append(
            spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r["file"])).toString())
    return sorted(arrays), sorted(others)


def _whole(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")


def _of_arrays(spark: SparkSession, paths) -> DataFrame:
    """S4 candidates of JSON array files, each cut between tasks.  Only files that are not plain
    arrays of valid objects (their paths come to the driver) are read whole,
    by the rule for the array as one value."""
    if not paths:
        return array_candidates(_none(spark, "source string, value string"))
    rows = AR.elements(spark, paths).withColumn("__e", F.when(F.col("closed"), F.from_json(AR.body(F.col("text")), _MAP)))
    fine = AR.is_plain() & (~F.col("closed") | F.col("__e").isNotNull())
    odd = [r["source"] for r in rows.groupBy("source").agg(
        F.bool_and(fine).alias("fine"), F.count_if(~F.col("closed")).alias("rests"))
        .where("not fine or rests != 1").select("source").collect()]
    cand = _session_rows(rows.where(F.col("closed") & ~F.col("source").isin(odd)))
    whole = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(o)).toString() for o in sorted(odd)]
    return cand.unionByName(array_candidates(_whole(spark, whole))) if whole else cand


def _none(spark: SparkSession, columns: str) -> DataFrame:
    return spark.createDataFrame([], columns)


def read_session(spark: SparkSession, path: str):
    """Saved sessions -> (events, candidates).  A file is a JSON array (read
    by element) or JSON lines (read by line)."""
    arrays, others = _by_start(spark, path)
    lines = _lines(spark, others) if others else _none(spark, "source string, line_no long, value string")
    cand = _of_arrays(spark, arrays).unionByName(line_candidates(lines))
    return events_of(cand), cand


def read_any(spark: SparkSession, path: str):
    """Per file, trimmed content starting with ``[`` is a session, else a
    log; logs are read by line."""
    arrays, others = _by_start(spark, path)
    lines = _lines(spark, others) if others else _none(spark, "source string, line_no long, value string")
    sess = _of_arrays(spark, arrays).withColumn("kind", F.lit("session"))
    logs = logcat_candidates(lines, "value", "line_no", "source").withColumn("kind", F.lit("log"))
    cand = sess.unionByName(logs)
    return events_of(cand), cand


def page_candidates(texts: DataFrame, id_col: str = "source", text_col: str = "value") -> DataFrame:
    """A raw array (old servers) or ``{"events": [...], ...}``; other
    shapes yield nothing."""
    t = F.regexp_replace(F.col(text_col), r"^\s+", "")
    arr = (F.when(t.startswith("["), F.from_json(F.col(text_col), _ARR))
            .when(t.startswith("{"), F.from_json(F.col(text_col), _PAGE)["events"]))
    ex = texts.select(F.col(id_col).alias("source"), F.posexplode(F.coalesce(arr, F.array().cast(_ARR)))
                      .alias("pos", "__e"))
    cols, ok = _event_cols(F.col("__e"))
    return ex.select("source", F.col("pos").cast("bigint").alias("seq"), F.lit(True).alias("candidate"),
                     (F.col("__e").isNotNull() & ok).alias("ok"), *cols)


def read_pages(spark: SparkSession, path: str):
    """Result pages -> (events, candidates)."""
    texts = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), "value")
    cand = page_candidates(texts)
    return events_of(cand), cand


def events_of(candidates: DataFrame) -> DataFrame:
    keep = [c for c in candidates.columns if c not in ("candidate", "ok")]
    return candidates.where(F.col("ok")).select(*keep)


def load_report(candidates: DataFrame) -> DataFrame:
    """Per source, (loaded, skipped).

    Session / page elements: skipped = elements - loaded.  Logs: skipped =
    max(0, lines mentioning the tag prefix - loaded), so human-readable trace
    lines count as skipped, as in the viewer.
    """
    kind = F.col("kind") if "kind" in candidates.columns else F.lit("any")
    g = (candidates.groupBy(kind.alias("kind"), "source")
                   .agg(F.count_if("ok").cast("bigint").alias("loaded"),
                        F.count(F.lit(1)).cast("bigint").alias("__n")))
    return g.select("kind", "source", "loaded",
                    F.greatest(F.lit(0), F.col("__n") - F.col("loaded")).cast("bigint").alias("skipped"))
