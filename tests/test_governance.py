"""Acceptance lines restated as tests: app list, delete, quota, repeats,
alerts (SURVEY §5.1 / §5.2 item 5)."""

from pyspark.sql import functions as F

from calltrail.operators import governance as G
from calltrail.operators import insights as IN
from calltrail.operators import paging as PG
from calltrail.operators import summary as A
from calltrail.streaming import live as LV
from calltrail.streaming.runner import run_update

EV = ("seq long, type string, class_name string, method string, ts long, app_id string, platform string, "
      "user_id string, tag string, device_model string, device_id string")


def test_app_list_order_and_v1_rows(spark):
    rows = [(1, "ENTER", "A", "m", 10, "a1", "web-js", "u1", "", "", "d1"),
            (2, "ENTER", "A", "m", 30, "a1", "android-jvm", "u1", "", "", "d1"),
            (3, "ENTER", "A", "m", 20, "a2", None, "u2", "", "", "d2"),
            (4, "ENTER", "A", "m", 99, None, None, None, "", "", None)]   # v1 client row
    apps = PG.apps_by_last_seen(A.app_summary(spark.createDataFrame(rows, EV))).collect()
    assert [(r["app_id"], r["event_count"], r["last_seen"], r["platforms"]) for r in apps] == [
        ("a1", 2, 30, ["android-jvm", "web-js"]), ("a2", 1, 20, [])]


def test_erase_keeps_rows_without_user(spark):
    rows = [(1, "ENTER", "A", "m", 1, "a", None, "u1", "", "", None),
            (2, "ENTER", "A", "m", 2, "a", None, None, "", "", None),
            (3, "ENTER", "A", "m", 3, "a", None, "u2", "", "", None)]
    df = spark.createDataFrame(rows, EV)
    assert [r["seq"] for r in G.erase_user(df, "u1").orderBy("seq").collect()] == [2, 3]
    assert G.erased_count(df, "u1").first()["erased"] == 1


def test_quota_over_limit_per_source_and_token(spark):
    # five requests in one minute from one source, two without a token
    req = spark.createDataFrame([("ip1", "t1", 60_000 + i) for i in range(3)] +
                                [("ip1", None, 61_000 + i) for i in range(2)] +
                                [("ip2", "t1", 125_000)], "source string, token string, ts long")
    out = {(r["kind"], r["key"], r["window_start"]): (r["requests"], r["over_limit"])
           for r in G.quota_audit(req, "source", "token", source_limit=4, token_limit=2).collect()}
    assert out[("source", "ip1", 60_000)] == (5, True)
    assert out[("token", "t1", 60_000)] == (3, True)
    assert out[("token", "anon", 60_000)] == (2, False)
    assert out[("source", "ip2", 120_000)] == (1, False)


def test_live_quota_equals_batch(spark, tmp_path):
    req = spark.createDataFrame([("ip1", "t1", 60_000 + i * 100) for i in range(7)] +
                                [("ip2", None, 600_000)], "source string, token string, ts long")
    path = str(tmp_path / "req")
    req.write.parquet(path)
    s = spark.readStream.schema(req.schema).parquet(path)
    live = run_update(spark, LV.live_quota(s, "source", "token", source_limit=5), "quota-test",
                      ["kind", "key", "window_start"])
    batch = G.quota_audit(req, "source", "token", source_limit=5)
    cols = ["kind", "key", "window_start", "requests", "over_limit"]
    assert sorted(tuple(r) for r in live.select(*cols).collect()) == \
        sorted(tuple(r) for r in batch.select(*cols).collect())


def test_repeats_and_drop(spark):
    rows = [(1, "ENTER", "A", "m", 5, "a", None, "u", "", "", None),
            (7, "ENTER", "A", "m", 5, "a", None, "u", "", "", None),     # retried copy
            (9, "ENTER", "A", "m", 6, "a", None, "u", "", "", None)]
    df = spark.createDataFrame(rows, EV)
    rep = {r["seq"]: r["copies"] for r in G.repeats(df, [c for c in df.columns if c != "seq"]).collect()}
    assert rep == {1: 2, 9: 1}
    kept = [r["seq"] for r in G.drop_repeats(df, [c for c in df.columns if c != "seq"]).orderBy("seq").collect()]
    assert kept == [1, 9]


def test_alert_threshold(spark):
    rows = [(i, "CATCH", "A", "m", 600_000 + i * 1000, "a", None, "u", "", "", None) for i in range(12)]
    out = IN.alert_windows(spark.createDataFrame(rows, EV), threshold=10)
    hot = out.where(F.col("alert")).collect()
    assert hot and all(r["events"] > 10 for r in hot)
    assert {r["window_start"] for r in hot} == {600_000 - k * 60_000 for k in range(5)}


def test_copies_that_share_an_id_are_reduced_to_one(spark):
    from calltrail.operators.governance import drop_repeats
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b")], "seq long, c string")
    assert sorted(tuple(r) for r in drop_repeats(df, ["c"]).collect()) == [(1, "a"), (3, "b")]


def test_demap_keeps_empty_stacks_and_single_frames(spark):
    from calltrail.operators.insights import demap_stacks
    df = spark.createDataFrame([(1, "m", ["a", "z"]), (2, "m", [])], "seq long, source_map_id string, stack array<string>")
    mapping = spark.createDataFrame([("m", "a", "A"), ("m", "a", "B")], "map_id string, frame string, original string")
    assert sorted((r.seq, r.stack, r.mapped) for r in demap_stacks(df, mapping).collect()) == [(1, ["A", "z"], 1), (2, [], 0)]


def test_anomaly_deviation_after_one_long_call(spark):
    from statistics import mean, stdev

    from calltrail.operators import insights as IN
    xs = [10 * 86_400_000] + [100 + i % 2 for i in range(60)]
    df = spark.createDataFrame([(i, "EXIT", "C", None, x) for i, x in enumerate(xs)],
                               "seq long, type string, class_name string, method string, duration_ms long")
    for rows in (20, 23, 100_000):  # a bucket's first rows look into the one before
        got = IN.latency_anomalies(df, k=20, chunk_span=7, bucket_rows=rows).orderBy("seq").collect()
        assert len(got) == len(xs)
        for i, r in enumerate(got):
            back = xs[max(0, i - 20):i]
            if len(back) >= 2:
                assert abs(r["baseline_mean"] - mean(back)) < 0.0051 and abs(r["baseline_sd"] - stdev(back)) < 0.0051
            else:
                assert r["baseline_sd"] is None


def test_null_class_or_method_keeps_its_rows(spark):
    from calltrail.operators import insights as IN
    from calltrail.operators import summary as SM
    df = spark.createDataFrame([(i, "EXIT", "C" if i % 2 else None, "m", i) for i in range(6)],
                               "seq long, type string, class_name string, method string, duration_ms long")
    seq = SM.method_type_sequence(df, chunk_span=2).where("name is null").orderBy("pos").collect()
    assert [(r["pos"], r["seq"]) for r in seq] == [(1, 0), (2, 2), (3, 4)]
    lat = {r["class_name"]: (r["n"], r["p50"]) for r in IN.latency(df).collect()}
    assert lat == {None: (3, 2.0), "C": (3, 3.0)}
