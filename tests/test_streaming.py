"""Streaming: ingest (T1), follow + late rule (T2, T3), device-log follow
(T4), notices (T6), live pairing (T7) equal to batch pairing."""

import gzip
import os
import random
import shutil

from pyspark.sql import functions as F

from calltrail.operators import calls as C
from calltrail.sources import store as ST
from calltrail.streaming import ingest as IG
from calltrail.streaming import live as LV
from calltrail.streaming.runner import run_append


def test_ingest_decodes_masks_appends(spark, fx, tmp_path):
    inbox, table, ck = str(tmp_path / "inbox"), str(tmp_path / "store"), str(tmp_path / "ck")
    os.makedirs(inbox)
    for f in ("batch_v1.json", "batch_bad.json"):
        shutil.copy(fx(f), inbox)
    with open(fx("batch_v2.json"), "rb") as f:  # a gzip body, known by its magic
        body = gzip.compress(f.read())
    with open(os.path.join(inbox, "batch_v2.bin"), "wb") as f:
        f.write(body)
    with open(os.path.join(inbox, "cut.gz"), "wb") as f:
        f.write(body[:-8])
    with open(os.path.join(inbox, "large.json"), "wb") as f:
        f.write(b"[" + b" " * 200_000 + b"]")
    q = IG.ingest_stream(spark, inbox, table, ck, available_now=True, max_raw=100_000)
    q.awaitTermination()
    ev = ST.read_events(spark, table)
    assert ev.count() == 4
    catch = ev.where(F.col("type") == "CATCH").first()
    assert catch["message"] == "token=*** failed"
    refused = {os.path.basename(r["batch_id"]): r["reason"] for r in spark.read.parquet(table + "_rejected").collect()}
    assert refused == {"batch_bad.json": "undecodable event", "cut.gz": "bad gzip body",
                       "large.json": "raw body over 100000 bytes"}
    assert os.listdir(os.path.join(table, "_judged")) == []
    assert not os.path.exists(os.path.join(table, "_staging", "load=1"))
    # a second run over the same inbox adds nothing (files already committed)
    IG.ingest_stream(spark, inbox, table, ck, available_now=True, max_raw=100_000).awaitTermination()
    assert ST.read_events(spark, table).count() == 4


def _rows(n0, n, ts0):
    return [(n0 + i, "ENTER", "C", "m", ts0 + i, "a") for i in range(n)]


def test_follow_and_compat_late_rule(spark, tmp_path):
    table = str(tmp_path / "store")
    schema = "seq long, type string, class_name string, method string, ts long, app_id string"
    ST.append_events(spark.createDataFrame(_rows(0, 5, 1000), schema), table, load_id=1)
    got, got_compat = [], []
    LV.follow(spark, table, lambda df, e: got.extend(r["seq"] for r in df.collect()),
              str(tmp_path / "ck1"), available_now=True, app_id="a").awaitTermination()
    LV.follow(spark, table, lambda df, e: got_compat.extend(r["seq"] for r in df.collect()),
              str(tmp_path / "ck2"), compat=True, available_now=True, app_id="a").awaitTermination()
    # late rows: ts below what was already delivered
    ST.append_events(spark.createDataFrame(_rows(100, 3, 500), schema), table, load_id=2)
    LV.follow(spark, table, lambda df, e: got.extend(r["seq"] for r in df.collect()),
              str(tmp_path / "ck1"), available_now=True, app_id="a").awaitTermination()
    LV.follow(spark, table, lambda df, e: got_compat.extend(r["seq"] for r in df.collect()),
              str(tmp_path / "ck2"), compat=True, available_now=True, app_id="a").awaitTermination()
    assert sorted(got) == [0, 1, 2, 3, 4, 100, 101, 102]
    assert sorted(got_compat) == [0, 1, 2, 3, 4]


def test_logcat_stream_and_new_labels(spark, fx, tmp_path):
    d = str(tmp_path / "logs")
    os.makedirs(d)
    shutil.copy(fx("logcat.txt"), d)
    ev = IG.logcat_stream(spark, d)
    out = run_append(spark, ev.select("type", "class_name", "method"), "logcat-test")
    assert sorted(r["type"] for r in out.collect()) == ["CATCH", "ENTER", "EXIT"]
    rows = [(i, "ENTER", "C", "m", i, "", "Pixel 7" if i % 2 else "SM-G", "m" + str(i % 3)) for i in range(9)]
    df = spark.createDataFrame(rows, "seq long, type string, class_name string, method string, ts long, "
                                     "tag string, device_model string, device_manufacturer string")
    src = str(tmp_path / "ev")
    df.write.parquet(src)
    s = spark.readStream.schema(df.schema).parquet(src)
    n = run_append(spark, LV.new_labels(s), "labels-test")
    assert sorted((r["kind"], r["value"]) for r in n.collect()) == [
        ("device", "Pixel 7"), ("device", "SM-G"), ("manufacturer", "m0"), ("manufacturer", "m1"),
        ("manufacturer", "m2")]


def test_live_pairs_equal_batch_across_microbatches(spark, tmp_path):
    rng = random.Random(3)
    rows, seq = [], 0
    for _ in range(400):
        seq += 1
        rows.append((seq, rng.choice([1, 2]), "t", rng.choice(["A", "B"]), rng.choice(["m", "n"]),
                     rng.choice(["ENTER", "ENTER", "EXIT", "EXIT", "BRANCH"]), 1_000_000 + seq * 1000, 5))
    schema = ("seq long, thread_id long, thread_name string, class_name string, method string, type string, "
              "ts long, duration_ms long")
    src = str(tmp_path / "src")
    for i in range(4):  # four files, one per micro-batch, in seq order
        spark.createDataFrame(rows[i * 100:(i + 1) * 100], schema).coalesce(1).write.mode("append").parquet(src)
    df = spark.createDataFrame(rows, schema)
    batch = {(r["enter_seq"], r["exit_seq"]) for r in C.pair_calls(df, "thread").collect() if r["exit_seq"]}
    files = sorted(f for f in os.listdir(src) if f.endswith(".parquet"))
    assert len(files) == 4
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = run_append(spark, LV.live_pairs(s, "thread"), "pairs-test")
    got = out.collect()
    live = {(r["enter_seq"], r["exit_seq"]) for r in got if r["kind"] == "pair"}
    orphans = {r["exit_seq"] for r in got if r["kind"] == "orphan"}
    batch_orphans = {r["seq"] for r in C.orphan_exits(df, "thread").collect()}
    assert live == batch
    assert orphans == batch_orphans


def test_live_pairs_evicts_old_open_calls(spark, tmp_path):
    schema = ("seq long, thread_id long, thread_name string, class_name string, method string, type string, "
              "ts long, duration_ms long")
    src = str(tmp_path / "src")
    first = [(1, 1, "t", "A", "m", "ENTER", 1_000, None), (2, 1, "t", "A", "m", "ENTER", 2_000, None)]
    later = [(3, 1, "t", "A", "m", "EXIT", 900_000, 5), (4, 1, "t", "B", "n", "ENTER", 2_000_000, None)]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(src)
    more = [(5, 1, "t", "A", "m", "ENTER", 2_100_000, None)]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = run_append(spark, LV.live_pairs(s, "thread", watermark="0 seconds", timeout_ms=60_000), "evict-test")
    rows = {(r["kind"], r["enter_seq"], r["exit_seq"]) for r in out.collect()}
    assert ("pair", 2, 3) in rows          # EXIT closes the latest open ENTER
    assert ("open", 1, None) in rows       # the older one is evicted once far behind the watermark


def test_follow_on_error_keeps_going(spark, tmp_path):
    table = str(tmp_path / "store")
    schema = "seq long, type string, class_name string, method string, ts long, app_id string"
    ST.append_events(spark.createDataFrame(_rows(0, 3, 1000), schema), table, load_id=1)
    errors = []

    def boom(df, epoch):
        raise ValueError("consumer failed")

    started = []
    q = LV.follow(spark, table, boom, str(tmp_path / "ck"), available_now=True,
                  on_error=lambda e, epoch: errors.append(str(e)), on_connected=started.append)
    q.awaitTermination()
    assert errors == ["consumer failed"]
    assert started == [q]


def test_follow_after_an_erase_delivers_nothing_again(spark, tmp_path):
    table, ck = str(tmp_path / "store"), str(tmp_path / "ck")
    schema = "seq long, type string, class_name string, method string, ts long, user_id string"
    ST.append_events(spark.createDataFrame([(i, "ENTER", "C", "m", i + 1, f"u{i % 2}") for i in range(6)], schema), table, load_id=1)
    got = []
    for _ in range(2):
        LV.follow(spark, table, lambda df, e: got.extend(r["seq"] for r in df.collect()), ck,
                  available_now=True).awaitTermination()
        assert sorted(got) == list(range(6))
        ST.erase_user(spark, table, "u1")
