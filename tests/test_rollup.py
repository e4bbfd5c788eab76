"""Figures kept in tables by a stream: late rows, replays, merged runs (T5, T8,
R1-R3, D4); the pairing state (T7)."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from calltrail.operators import calls as C
from calltrail.operators import governance as G
from calltrail.operators import insights as IN
from calltrail.streaming import live as LV
from calltrail.streaming import rollup as RU
from calltrail.streaming.runner import run_loads

DAY = 86_400_000
SCHEMA = "seq long, ts long, type string, app_id string, user_id string, class_name string, method string, duration_ms long, source string, token string"


def _events(spark, n, first=0, days=(0,), seed=1):
    rng = random.Random(seed + first)
    rows = [(first + i, rng.choice(days) * DAY + rng.randrange(DAY // 400), rng.choice(["CATCH", "EXIT"]),
             rng.choice(["a", "b", None]), f"u{rng.randrange(n)}", "C", rng.choice(["m", "n"]), rng.randrange(5000),
             rng.choice(["s1", "s2"]), rng.choice(["t", None])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def _rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def _batches(spark):
    # the last batch is a month older than the others
    return [_events(spark, 40, 100 * k, (40, 41)) for k in range(6)] + [_events(spark, 40, 900, (5, 40))]


@pytest.mark.parametrize("fanout", [2, 16])
def test_quota_and_alerts_take_late_rows_and_replays(spark, tmp_path, fanout):
    parts = _batches(spark)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    quota, alerts = RU.quota_rollup("source", "token", 3, 3), RU.alert_rollup(threshold=2)
    q, a = str(tmp_path / "q"), str(tmp_path / "a")
    for number, part in enumerate(parts):
        for _ in range(2):  # the second is a replay
            RU.add_run(quota, part, q, number, fanout)
            RU.add_run(alerts, part, a, number, fanout)
    assert _rows(RU.read_rollup(spark, quota, q)) == _rows(G.quota_audit(every, "source", "token", "ts", 3, 3))
    assert _rows(RU.read_rollup(spark, alerts, a)) == _rows(IN.alert_windows(every, threshold=2))
    runs = RU._cover(RU._done(spark, q))
    assert runs[0][0] == 0 and runs[-1][1] == 6 and len(runs) == (3 if fanout == 2 else 7)
    old = RU.read_rollup(spark, quota, q, until_day="1970-02-01")
    assert old.count() > 0 and "PartitionFilters: [isnotnull(day" in old._jdf.queryExecution().executedPlan().toString()


def test_a_run_without_its_record_does_not_count(spark, tmp_path):
    quota, path = RU.quota_rollup("source", "token"), str(tmp_path / "q")
    RU.add_run(quota, _events(spark, 20), path, 0)
    before = _rows(RU.read_rollup(spark, quota, path))
    quota.partial(_events(spark, 20, 50)).write.partitionBy("day").parquet(f"{path}/runs/1-1")  # a crash came before the record
    assert _rows(RU.read_rollup(spark, quota, path)) == before
    RU.add_run(quota, _events(spark, 30, 100), path, 1)
    both = _events(spark, 20).unionByName(_events(spark, 30, 100))
    assert _rows(RU.read_rollup(spark, quota, path)) == _rows(G.quota_audit(both, "source", "token", "ts"))


def test_sketches_merge_over_days(spark, tmp_path):
    path, parts = str(tmp_path / "u"), [_events(spark, 3000, 5000 * k, (1, 2, 3)) for k in range(3)]
    for number, part in enumerate(parts):
        RU.add_run(RU.usage_rollup(), part, path, number, 2)
        RU.add_run(RU.latency_rollup(), part, path + "l", number, 2)
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    want = {r["app_id"]: r for r in every.groupBy("app_id").agg(F.countDistinct("user_id").alias("u"), F.count("*").alias("n")).collect()}
    for r in RU.read_rollup(spark, RU.usage_rollup(), path, by=["app_id"]).collect():
        assert r["events"] == want[r["app_id"]]["n"] and abs(r["users"] - want[r["app_id"]]["u"]) <= 0.033 * want[r["app_id"]]["u"]
    got = RU.read_rollup(spark, RU.latency_rollup(), path + "l", by=["class_name", "method"])
    checked = IN.rank_check(every, max_ms=None, approx=got, error=0.008).collect()
    assert len(checked) == 2 and all(r["p50_ok"] and r["p95_ok"] and r["p99_ok"] for r in checked)
    day = RU.read_rollup(spark, RU.usage_rollup(), path, since_day="1970-01-03", until_day="1970-01-03", by=["app_id"])
    exact = every.where(f"ts div {DAY} = 2").groupBy("app_id").count()
    assert sorted((str(r[0]), r[1]) for r in day.select("app_id", "events").collect()) == sorted((str(a), n) for a, n in exact.collect())


def test_first_copies_however_late(spark, tmp_path):
    base = str(tmp_path)
    parts = _batches(spark)[:3]
    again = parts[0].withColumn("seq", F.col("seq") + 10_000)
    for part in [*parts, again, parts[1].withColumn("seq", F.col("seq") + 20_000).unionByName(_events(spark, 5, 3000))]:
        part.write.mode("append").parquet(f"{base}/in")
        RU.keep_first(spark.readStream.schema(part.schema).parquet(f"{base}/in"), f"{base}/t", f"{base}/ck",
                      columns=[c for c in part.columns if c != "seq"], available_now=True).awaitTermination()
    got = [r["seq"] for r in RU.read_first(spark, f"{base}/t", parts[0].schema).collect()]
    assert len(got) == len(set(got)) and max(s for s in got if s < 3000) < 1000
    assert sorted(got) == sorted(r["seq"] for p in [*parts, _events(spark, 5, 3000)] for r in p.collect())


# --- the state of live pairs ------------------------------------------------------------

class _Map(dict):
    writes = 0

    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        _Map.writes += 1
        self[k] = v

    def removeKey(self, k):
        _Map.writes += 1
        del self[k]


class _Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


def test_a_push_or_pop_writes_one_entry():
    p = LV.Pairing(None)
    p.handle, p.open, p.ends = None, _Map(), _Value()

    def give(*rows):
        pdf = pd.DataFrame(rows, columns=["type", "seq", "ts", "duration_ms"])
        return [tuple(r) for f in p.handleInputRows(("s", "C", "m"), iter([pdf]), None) for r in f.itertuples(index=False)]

    give(*[("ENTER", i, i, None) for i in range(1000)])
    assert _Map.writes == 1000 and len(p.open) == 1000
    _Map.writes = 0
    out = give(("EXIT", 2000, 2000, 7))
    assert _Map.writes == 1 and out[0][4:6] == (999, 2000)
    _Map.writes = 0
    out = give(("ENTER", 3000, 1, None), ("EXIT", 3001, 2, None), ("EXIT", 3002, 3, None), ("ENTER", 3003, 4, None))
    assert _Map.writes == 2 and [r[4] for r in out] == [3000, 998]
    give(*[("EXIT", 4000 + i, 1, None) for i in range(999)])
    assert not p.open and not p.ends.exists()   # a key without open calls has no state
    assert give(("EXIT", 9000, 1, None))[0][3] == "orphan"


def test_ten_micro_batches_pair_as_the_batch_does(spark):
    rng = random.Random(11)
    schema = ("seq long, thread_id long, thread_name string, class_name string, method string, type string, "
              "ts long, duration_ms long")
    rows = [(i, rng.choice([1, 2]), "t", rng.choice(["A", None]), rng.choice(["m", "n"]), rng.choice(["ENTER", "EXIT"]),
             1_000_000 + i, 5) for i in range(600)]
    parts = [spark.createDataFrame(rows[k:k + 60], schema).coalesce(1) for k in range(0, 600, 60)]
    own = LV.pairing_session(spark)
    out = run_loads(own, parts, lambda s: LV.live_pairs(s, "thread"), "ten").collect()
    df = spark.createDataFrame(rows, schema)
    batch = {(r["enter_seq"], r["exit_seq"]) for r in C.pair_calls(df, "thread").collect() if r["exit_seq"] is not None}
    assert {(r["enter_seq"], r["exit_seq"]) for r in out if r["kind"] == "pair"} == batch
    assert {r["exit_seq"] for r in out if r["kind"] == "orphan"} == {r["seq"] for r in C.orphan_exits(df, "thread").collect()}


def test_pairing_asks_for_its_state_store(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    stream = other.readStream.format("rate").load().selectExpr(
        "value as seq", "1L as thread_id", "'t' as thread_name", "'A' as class_name", "'m' as method", "'ENTER' as type",
        "value as ts", "1L as duration_ms")
    with pytest.raises(ValueError, match="RocksDB"):
        LV.live_pairs(stream)
