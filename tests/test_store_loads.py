"""Who owns a load (S8, T1), erases and what follows them."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from calltrail.sources import loads as LD
from calltrail.sources import store as ST
from calltrail.streaming import ingest as IG
from calltrail.streaming import live as LV

SCHEMA = "type string, class_name string, method string, ts long, user_id string"
DAY = 86_400_000


def _load(spark, n, first=0, users=3, parts=2):
    rows = [("ENTER", "C", f"m{first + i}", DAY * (i % 2) + first + i + 1, f"u{i % users}") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def _inbox(path, first, n):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/b{first}.json", "w") as f:
        json.dump([{"type": "ENTER", "class": "C", "method": f"m{first + i}", "ts": first + i} for i in range(n)], f)


def _methods(spark, table):
    return sorted(r["method"] for r in ST.read_events(spark, table).select("method").collect())


def test_two_inboxes_a_new_checkpoint_and_an_own_load_lose_nothing(spark, tmp_path):
    table = str(tmp_path / "t")
    ST.append_events(_load(spark, 9), table, load_id=1)

    def ingest(inbox, ckpt):
        IG.ingest_stream(spark, str(tmp_path / inbox), table, str(tmp_path / ckpt), available_now=True).awaitTermination()

    _inbox(str(tmp_path / "a"), 100, 7)
    _inbox(str(tmp_path / "b"), 200, 5)
    ingest("a", "ck-a")
    ingest("b", "ck-b")
    _inbox(str(tmp_path / "a"), 300, 2)
    ingest("a", "ck-a")
    _inbox(str(tmp_path / "c"), 400, 3)
    ingest("c", "ck-c")
    ST.append_events(_load(spark, 4, 500), table, load_id=0)
    want = sorted(f"m{i}" for i in [*range(9), *range(100, 107), *range(200, 205), 300, 301, 400, 401, 402, *range(500, 504)])
    assert _methods(spark, table) == want
    assert ST.read_events(spark, table).select("seq").distinct().count() == len(want)
    ingest("a", "ck-a")                                             # nothing new
    assert ST.append_events(_load(spark, 9, parts=5), table, load_id=1) == 0
    assert _methods(spark, table) == want


def test_a_replayed_micro_batch_adds_nothing(spark, tmp_path):
    table, ck = str(tmp_path / "t"), tmp_path / "ck"
    _inbox(str(tmp_path / "a"), 0, 6)
    for _ in range(2):  # the checkpoint forgets that the batch was done, as after a crash before its commit
        IG.ingest_stream(spark, str(tmp_path / "a"), table, str(ck), available_now=True).awaitTermination()
        for f in (ck / "commits").glob("*0*"):
            f.unlink()
    assert _methods(spark, table) == [f"m{i}" for i in range(6)]


def test_other_rows_under_a_number_in_use_are_refused(spark, tmp_path):
    table = str(tmp_path / "t")
    ST.append_events(_load(spark, 5), table, load_id=7)
    with pytest.raises(LD.LoadClash):
        ST.append_events(_load(spark, 5, 50), table, load_id=7)
    number = LD.claim_number(spark, table, "stream x", 0)
    assert number >= LD.FIRST_CLAIMED and LD.claim_number(spark, table, "stream x", 0) == number
    assert LD.claim_number(spark, table, "stream x", 1) == number + 1 and LD.claim_number(spark, table, "y", 0) == number + 2
    with pytest.raises(LD.LoadClash):
        ST.append_events(_load(spark, 5), table, load_id=number)
    assert ST.append_events(_load(spark, 2, 90), table) > 0 and ST.append_events(_load(spark, 2, 90), table) > 0
    assert len(_methods(spark, table)) == 9


def test_of_many_writers_of_one_file_one_succeeds(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if LD.put_new(spark, str(tmp_path / "d/one"), f"w{i}") else None)
               for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and LD.text_of(spark, str(tmp_path / "d/one")) == f"w{won[0]}"
    assert os.listdir(tmp_path / "d") == ["one"]


def _follow(spark, table, ck, got):
    LV.follow(spark, table, lambda df, e: got.extend(r["method"] for r in df.collect()), ck,
              available_now=True).awaitTermination()
    return sorted(got)


def test_followers_after_an_erase_get_the_rows_left(spark, tmp_path):
    table = str(tmp_path / "t t")
    ST.append_events(_load(spark, 6), table, load_id=1)
    old, lagging, fresh = [], [], []
    _follow(spark, table, str(tmp_path / "old"), old)
    _follow(spark, table, str(tmp_path / "lag"), lagging)
    ST.append_events(_load(spark, 6, 10), table, load_id=2)
    _follow(spark, table, str(tmp_path / "old"), old)
    assert ST.erase_user(spark, table, "u1") == 4
    ST.append_events(_load(spark, 3, 20), table, load_id=3)   # the user may come back
    assert ST.erase_user(spark, table, "u0") == 5
    left = lambda a, n, gone: [f"m{a + i}" for i in range(n) if f"u{i % 3}" not in gone]
    last = left(20, 3, {"u0"})
    assert _follow(spark, table, str(tmp_path / "old"), old) == sorted(left(0, 6, ()) + left(10, 6, ()) + last)
    assert _follow(spark, table, str(tmp_path / "lag"), lagging) == sorted(left(0, 6, ()) + left(10, 6, {"u0", "u1"}) + last)
    assert _follow(spark, table, str(tmp_path / "new"), fresh) == _methods(spark, table)
    ST.clear_events(spark, table)
    ST.append_events(_load(spark, 2, 70), table, load_id=1)   # a cleared store may use a number again
    assert _follow(spark, table, str(tmp_path / "new"), fresh)[-2:] == ["m70", "m71"]


def test_files_of_other_writers_are_followed_and_erased(spark, tmp_path):
    table = str(tmp_path / "t")
    _load(spark, 6).withColumn("event_date", F.lit("1970-01-01").cast("date")).coalesce(1).write.partitionBy("event_date").parquet(table)
    first, fresh = [], []
    assert _follow(spark, table, str(tmp_path / "ck"), first) == [f"m{i}" for i in range(6)]
    assert ST.erase_user(spark, table, "u2") == 2
    assert _follow(spark, table, str(tmp_path / "ck"), first) == [f"m{i}" for i in range(6)]
    assert _follow(spark, table, str(tmp_path / "ck2"), fresh) == ["m0", "m1", "m3", "m4"]


def test_an_erase_opens_only_files_that_may_hold_the_user(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    for i in range(6):  # each load has users of its own
        ST.append_events(_load(spark, 4, 10 * i).withColumn("user_id", F.concat(F.lit(f"l{i}-"), "user_id")), table, load_id=i)
    files = ST.files_that_may_hold(spark, table, "l2-u0")
    assert len(ST.files_of(spark, table)) >= 12 and files and all("/load-2-" in f for f in files)
    days = {f.rsplit("/", 2)[1] for f in ST.files_that_may_hold(spark, table, "l3-u2")}
    assert days == {"event_date=1970-01-01"}  # one row of that user, on the first day
    assert ST.files_that_may_hold(spark, table, "nobody") == []
    assert ST.erase_user(spark, table, "l2-u0") == 2 and ST.erase_user(spark, table, "l2-u0") == 0
    assert ST.erase_user(spark, table, "l2-u1") == 1  # the index still finds the rewritten files


def test_an_exchange_that_breaks_off_is_finished(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    ST.append_events(_load(spark, 12), table, load_id=1)
    real = ST._recover

    def cut(s, root):
        text = LD.text_of(s, f"{root}/_erase/journal")
        if text is None:
            return
        src, dst = json.loads(text)["moves"][0]
        src, dst = (x.removeprefix("file://") for x in (src, dst))
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        os.rename(src, dst)
        raise OSError("crash")

    monkeypatch.setattr(ST, "_recover", cut)
    with pytest.raises(OSError):
        ST.erase_user(spark, table, "u1")
    monkeypatch.setattr(ST, "_recover", real)
    assert ST.erasing(spark, table)
    assert ST.erase_user(spark, table, "u1") == 0
    assert _methods(spark, table) == sorted(f"m{i}" for i in range(12) if i % 3 != 1)
    assert not ST.erasing(spark, table)


def test_one_erase_at_a_time(spark, tmp_path):
    table = str(tmp_path / "t")
    ST.append_events(_load(spark, 3), table, load_id=1)
    with LD.lock(spark, f"{table}/_erase/lock"):
        with pytest.raises(LD.StoreBusy):
            ST.erase_user(spark, table, "u1")
        with LD.lock(spark, f"{table}/_erase/lock", lease_s=0.0):  # its holder is dead by now
            pass
    assert ST.erase_user(spark, table, "u1") == 1


def test_a_load_staged_before_an_erase_does_not_bring_the_user_back(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    real = ST._move_in

    def crash(*a):
        raise OSError("crash")

    for number in (1, 2):
        monkeypatch.setattr(ST, "_move_in", crash)
        with pytest.raises(OSError):
            ST.append_events(_load(spark, 6, 10 * number), table, load_id=number)
        monkeypatch.setattr(ST, "_move_in", real)
    # an attempt that was never ready is removed, and a judged batch too
    os.makedirs(f"{table}/_judged/9")
    os.makedirs(f"{table}/_staging/load=5/rows")
    assert ST.erase_user(spark, table, "u0") == 0               # loads 1 and 2 may still be at work
    assert ST.append_events(_load(spark, 6, 10), table, load_id=1) > 0
    assert _methods(spark, table) == ["m11", "m12", "m14", "m15"]
    assert ST.erase_user(spark, table, "u1", idle_s=-5) == 4    # load 2 is finished, then erased
    assert _methods(spark, table) == ["m12", "m15", "m22", "m25"]
    assert os.listdir(f"{table}/_judged") == [] and os.listdir(f"{table}/_staging") == []
    got = []
    assert _follow(spark, table, str(tmp_path / "ck"), got) == ["m12", "m15", "m22", "m25"]


def test_whole_batches_get_the_same_ids_without_being_written(spark, tmp_path):
    rows = [(f"f{b}", p, f"{b}-{p}") for b in (10, 2, 33, 4) for p in range(b)]
    df = spark.createDataFrame(rows, "batch_id string, pos int, method string").repartition(5)
    want = {r["method"]: r["seq"] for r in ST.assign_seq(df, 7, str(tmp_path / "w")).collect()}
    got = {r["method"]: r["seq"] for r in ST.seq_by_batch(df, 7).collect()}
    assert got == want and min(got.values()) == 7 << 36
    own = df.withColumn("seq", F.col("pos").cast("long") + 5)
    kept = ST.assign_seq(own, 7, str(tmp_path / "none"))
    assert sorted(r["seq"] for r in kept.collect()) == sorted(p + 5 for _, p, _ in rows)
    assert not (tmp_path / "none").exists()
    some = own.withColumn("seq", F.when(F.col("pos") > 0, F.col("seq")))
    filled = ST.assign_seq(some, 7, str(tmp_path / "some")).where("pos = 0")
    assert {r["method"]: r["seq"] for r in filled.collect()} == {m: s for m, s in want.items() if m.endswith("-0")}


def test_an_inbox_session_lists_files_in_few_tasks_and_keeps_settings(spark):
    name, old = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.conf.get("spark.sql.ansi.enabled")
    before = spark.conf.get(name)
    own = IG.inbox_session(spark)
    assert int(own.conf.get(name)) == spark.sparkContext.defaultParallelism
    assert own.conf.get("spark.sql.ansi.enabled") == old and spark.conf.get(name) == before


def test_known_sizes_number_batches_without_a_job_and_refuse_too_many_rows(spark):
    df = spark.createDataFrame([(b, p) for b in ("ä", "b", "a b") for p in range(len(b) + 1)], "batch_id string, pos int")
    sizes = {"ä": 2, "b": 2, "a b": 4, None: 3}
    got = ST.seq_by_batch(df, 3, sizes)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(got.collect(), key=lambda r: r["seq"])
    assert [r["seq"] - (3 << 36) for r in rows] == list(range(8))
    assert [(r["batch_id"], r["pos"]) for r in rows[::2]] == [("a b", 0), ("a b", 2), ("b", 0), ("ä", 0)]
    with pytest.raises(ValueError):
        ST.seq_by_batch(df, 3, {"b": 1 << 36, "ä": 1})
    assert ST.seq_by_batch(df, 3, {}).count() == 0


def test_steps_at_once_all_end_and_one_error_is_raised(spark):
    both, ended = threading.Barrier(2, timeout=30), []
    group = lambda: spark.sparkContext.getLocalProperty("spark.jobGroup.id")

    def fails():
        both.wait()
        raise OSError("one")

    def ends():
        both.wait()
        ended.append((group(), spark.range(5).count()))

    spark.sparkContext.setJobGroup("mine", "")
    try:
        with pytest.raises(OSError, match="one"):
            LD.at_once(spark, fails, ends)
        with pytest.raises(OSError, match="one"):
            LD.at_once(spark, ends, fails)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert ended == [("mine", 5)] * 2


def test_an_inbox_session_reads_many_small_files_in_a_task_per_core(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(1000):
        (tmp_path / f"in/{i}.json").write_text("[]")
    own = IG.inbox_session(spark)
    cores = spark.sparkContext.defaultParallelism
    assert own.read.format("binaryFile").load(str(tmp_path / "in")).rdd.getNumPartitions() <= cores + 1
    assert int(own.conf.get("spark.sql.streaming.fileSource.log.compactInterval")) == 100


def test_the_query_runs_both_inboxes_at_the_same_time(spark, tmp_path, monkeypatch):
    from calltrail.plans import stored as Q
    spark.range(700).selectExpr(
        "id AS event_id", "timestamp_micros(1704067200000000 + id * 3600000000) AS ts", "id % 9 AS user_id",
        "element_at(array('click', 'view', 'error', 'signup', 'other'), cast(id % 5 + 1 AS int)) AS event_type",
        "id / 7 AS value", "concat('{\"k\":', id % 100, '}') AS props").write.parquet(str(tmp_path / "events.parquet"))
    real, events = IG.ingest_stream, []

    class Watched:
        def __init__(self, stream, name):
            self.stream, self.name = stream, name
            events.append(("start", name))

        def awaitTermination(self):
            self.stream.awaitTermination()
            events.append(("end", self.name))

    monkeypatch.setattr(IG, "ingest_stream", lambda s, inbox, *a, **k: Watched(real(s, inbox, *a, **k), inbox[-3:]))
    rows = Q.QUERIES["ingest_two_inboxes"](spark, str(tmp_path))
    assert [k for k, _ in events] == ["start", "start", "end", "end"] * 2
    want = Q.trace(spark, str(tmp_path)).select(*rows.columns)
    assert rows.count() == 700 and rows.exceptAll(want).count() == 0


def test_streams_and_an_own_append_write_to_one_store_at_the_same_time(spark, tmp_path):
    table = str(tmp_path / "t")
    for i in range(4):
        _inbox(str(tmp_path / "a"), 100 + 10 * i, 7)
        _inbox(str(tmp_path / "b"), 200 + 10 * i, 5)
    (tmp_path / "c").mkdir()
    (tmp_path / "c/bad.json").write_text("[{]")              # a micro-batch of refused files only
    (tmp_path / "c/other.json").write_text('{"a":1}')
    own = IG.inbox_session(spark)
    streams = [IG.ingest_stream(own, str(tmp_path / i), table, str(tmp_path / f"ck-{i}"), max_files=2, available_now=True)
               for i in "abc"]
    ST.append_events(_load(spark, 9), table, load_id=1)
    for s in streams:
        s.awaitTermination()
    want = [f"m{i}" for i in range(9)] + [f"m{100 + 10 * i + j}" for i in range(4) for j in range(7)] + \
        [f"m{200 + 10 * i + j}" for i in range(4) for j in range(5)]
    assert _methods(spark, table) == sorted(want)
    assert ST.read_events(spark, table).select("seq").distinct().count() == len(want)
    refused = spark.read.parquet(f"{table}_rejected").collect()
    assert sorted((r["batch_id"].rsplit("/", 1)[1], r["reason"]) for r in refused) == [
        ("bad.json", "malformed JSON"), ("other.json", "not a JSON array")]
    assert os.listdir(f"{table}/_judged") == [] and os.listdir(f"{table}/_staging") == []
