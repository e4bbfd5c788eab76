"""Continuous ingest (T1) and device-log follow (T4)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrail.functions import masking as M
from calltrail.sources import loads as LD
from calltrail.sources.batches import MAX_INFLATED_BYTES, MAX_RAW_BYTES, bodies_of, decode_rows, split_rows
from calltrail.sources.logs import events_of, logcat_candidates
from calltrail.sources.store import append_events, seq_by_batch
from calltrail.streaming.tail import tail_lines


def mask_events(df: DataFrame, words=None, key_patterns=None, text_rules=None) -> DataFrame:
    """P12 + P13 on params, P14 on message, exception, result and stack.
    ``[]`` for a list turns that masker off; ``None`` uses its defaults."""
    p = F.col("params")
    if words is None or words:
        p = M.mask_params_by_words(p, words)
    if key_patterns is None or key_patterns:
        p = M.mask_params_by_regex(p, key_patterns)
    out = {"params": p}
    if text_rules is None or text_rules:
        for c in ("message", "exception", "result"):
            out[c] = M.mask_text(c, text_rules)
        out["stack"] = M.mask_text_array("stack", text_rules)
    return df.withColumns(out)


#: What a streamed ``binaryFile`` folder looks like (a stream needs it said).
_FILES = "path string, modificationTime timestamp, length long, content binary"


def inbox_session(spark: SparkSession) -> SparkSession:
    """A session beside `spark` (same context and settings) for streams over many small
    files: a micro-batch's files are listed and read by as many tasks as there are cores, not
    one per file or per 32 files, and the log of the files seen, which is written whole
    each time, is put together every 100 micro-batches instead of every 10."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.files.openCostInBytes", str(64 << 10))
    own.conf.set("spark.sql.streaming.fileSource.log.compactInterval", "100")
    return own


def ingest_stream(spark: SparkSession, inbox: str, table: str, checkpoint: str,
                  trigger: str = "3 seconds", max_files: int = 1000, available_now: bool = False,
                  words=None, key_patterns=None, text_rules=None, max_raw: int = MAX_RAW_BYTES,
                  max_inflated: int = MAX_INFLATED_BYTES):
    """Batch files arriving in ``inbox`` -> bodies (S2: gzip by magic, both
    caps), decoded (S1), masked, appended (S8).

    A file is one batch (all-or-nothing).  A micro-batch is read and judged
    once: its rows are written to ``<table>/_judged`` and split from there; the driver gets the
    number of events of each file.  Refused batches go to ``<table>_rejected/load=<number>`` (overwritten by a
    replay), events to the store as one load with ids in (file, index) order.  The
    load is known by this stream (the id in its checkpoint) and the micro-batch,
    so a replay after a failure adds nothing that was committed, and any number of streams,
    checkpoints and own appends may write to one store, at the same time too.  Spark lists a
    micro-batch's files one task each; a session of ``inbox_session`` does it in a task per core.
    """
    files = (spark.readStream.format("binaryFile").schema(_FILES)
                  .option("maxFilesPerTrigger", str(max_files)).load(inbox))
    rows, root = decode_rows(bodies_of(files, max_raw, max_inflated)), table.rstrip("/")
    schema = rows.schema

    def write(df: DataFrame, epoch: int):
        source = stream_source(spark, checkpoint)
        number = LD.claim_number(spark, root, source, epoch)
        if LD.exists(spark, f"{root}/_loads/done/{number}"):
            return
        work = f"{root}/_judged/{number}"
        df.write.mode("overwrite").parquet(work)
        events, rejected = split_rows(df.sparkSession.read.schema(schema).parquet(work))
        sizes = {}

        def count():
            sizes.update((r["batch_id"], r["n"]) for r in events.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).collect())

        # at most a row per file: one task writes them
        LD.at_once(spark, count, lambda: rejected.coalesce(1).write.mode("overwrite").parquet(f"{root}_rejected/load={number}"))
        events = seq_by_batch(events, number, sizes)
        append_events(mask_events(events, words, key_patterns, text_rules), table, source=source, batch=epoch, numbered=True)
        fs, jp = LD.fs_of(spark, work)
        fs.delete(jp, True)

    w = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()


def logcat_stream(spark: SparkSession, log_dir: str, max_files: int = 100) -> DataFrame:
    """T4: rotated device-log files, each complete when it appears, as a stream
    of events (S3).  Files that grow: ``logcat_tail``."""
    lines = (spark.readStream.option("maxFilesPerTrigger", str(max_files)).text(log_dir)
                  .select(F.col("_metadata.file_path").alias("file"), "value"))
    # Line order is not known in a stream; seq stays null until the store's
    # append assigns it (load number, then position).
    cand = logcat_candidates(lines.withColumn("line_no", F.lit(None).cast("bigint")),
                             "value", "line_no", "file")
    return events_of(cand)


def logcat_tail(spark: SparkSession, path: str, pattern: str = "*", split_bytes: int = 64 << 20) -> DataFrame:
    """T4: device logs that are being written, as a stream of events (S3) in
    their order in the file: ``source`` is the file and ``pos`` the byte at which an
    event's line starts.  Each whole line arrives once (``streaming.tail``)."""
    lines = tail_lines(spark, path, pattern, split_bytes)
    events = events_of(logcat_candidates(lines, "value", "pos", "file"))
    return events.withColumnRenamed("seq", "pos")


def ingest_logs(spark: SparkSession, path: str, table: str, checkpoint: str, pattern: str = "*",
                trigger: str = "3 seconds", available_now: bool = False, words=None, key_patterns=None, text_rules=None):
    """T4 + S8: ``logcat_tail`` into the store, masked.  A micro-batch is a load
    known by this stream and its number, in (file, position) order, so a replay adds nothing."""
    def write(df: DataFrame, epoch: int):
        source = stream_source(spark, checkpoint)
        if load_done(spark, table, source, epoch):
            return
        append_events(mask_events(df, words, key_patterns, text_rules), table, order=["source", "pos"], source=source, batch=epoch)

    w = logcat_tail(spark, path, pattern).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()


def stream_source(spark: SparkSession, checkpoint: str) -> str:
    """The name of a stream as a source of loads: the id in its checkpoint."""
    return "stream " + json.loads(LD.text_of(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]


def load_done(spark: SparkSession, table: str, source: str, batch) -> bool:
    root = table.rstrip("/")
    return LD.exists(spark, f"{root}/_loads/done/{LD.claim_number(spark, root, source, batch)}")
