"""Issue status, rule alerts in batch and stream (R1, R2), windows of the tree."""

import random

import pytest
from pyspark.sql import functions as F

from calltrail.operators import calls as C
from calltrail.operators import rules as RL
from calltrail.sources import store as ST
from calltrail.streaming import live as LV

SCHEMA = "seq long, ts long, type string, class_name string, method string, app_id string, exception string, stack array<string>"
STATUS = "app_id string, fingerprint string, ts long, status string"


def _events(spark, n=300, seed=1, apps=("a", "b", None)):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(200_000), rng.choice(["CATCH", "CATCH", "EXIT"]), "C", "m", rng.choice(apps), rng.choice(["X", "Y", None]), None)
            for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def _rules(spark, *more):
    return spark.createDataFrame([("n", "new", None, None, None), ("na", "new", "a", None, None), ("r", "reopened", None, None, None),
                                  ("c3", "count", None, 3, 5_000), ("cb", "count", "b", 0, 1_000), *more], RL.RULES_SCHEMA)


def _brute(events, rules, statuses):
    occ, out = {}, []
    for r in RL.occurrences(events).collect():
        occ.setdefault((r["app"]["app_id"], r["fingerprint"]), []).append((r["ts"], r["seq"]))
    for (app, fp), at in occ.items():
        at.sort()
        changes = sorted({(s["ts"], s["status"]) for s in statuses.where("ts is not null").collect() if (s["app_id"], s["fingerprint"]) == (app, fp)})
        last = dict(changes)  # of equal times the last by name
        for r in rules.collect():
            if r["app_id"] not in (None, app):
                continue
            if r["kind"] == "new":
                out.append((r["rule"], app, fp, *at[0]))
            elif r["kind"] == "reopened":
                times = sorted(last)
                for k, t in enumerate(times):
                    until = times[k + 1] if k + 1 < len(times) else float("inf")
                    hit = [x for x in at if t < x[0] <= until]
                    if last[t] == "resolved" and hit:
                        out.append((r["rule"], app, fp, *hit[0]))
            else:
                for k, (t, s) in enumerate(at):
                    inside = sum(t - u < r["window_ms"] for u, _ in at[:k + 1])
                    if inside == r["threshold"] + 1:
                        out.append((r["rule"], app, fp, t, s))
    return sorted(out, key=repr)


def _statuses(spark, events, seed=2):
    rng = random.Random(seed)
    issues = [(r["app"]["app_id"], r["fingerprint"]) for r in RL.occurrences(events).select("app", "fingerprint").distinct().collect()]
    rows = [(*i, rng.randrange(0, 200_000, 20_000), rng.choice(["resolved", "resolved", "ignored"])) for i in issues for _ in range(4)]
    return spark.createDataFrame(rows + [("zz", "none", 5, "resolved"), (*issues[0], None, "resolved")], STATUS)


def test_rules_against_brute_force(spark):
    events, rules = _events(spark), _rules(spark)
    statuses = _statuses(spark, events)
    got = sorted((tuple(r) for r in RL.firings(events, rules, statuses).collect()), key=repr)
    assert got == _brute(events, rules, statuses)
    assert {r[0] for r in got} == {"n", "na", "r", "c3", "cb"}
    same = sorted((tuple(r) for r in RL.over_count(RL.occurrences(events), rules, span_ms=700).collect()), key=repr)
    assert same == [r for r in got if r[0] in ("c3", "cb")]
    assert RL.firings(events.where("false"), rules, statuses).count() == 0
    with pytest.raises(ValueError, match="rules"):
        RL.firings(events, _rules(spark, *[(str(i), "count", None, 1, 1) for i in range(RL.MAX_RULES)]))


def test_each_rule_fires_once_per_change_in_a_stream(spark, tmp_path):
    events, rules = _events(spark), _rules(spark)
    statuses = _statuses(spark, events)
    for i in range(4):
        part = events.where((F.col("ts") >= 50_000 * i) & (F.col("ts") < 50_000 * (i + 1)))
        ST.append_events(part, str(tmp_path / "t"), load_id=i)
        for _ in range(2):  # nothing new the second time
            LV.live_rules(spark, str(tmp_path / "t"), rules, str(tmp_path / "out"), str(tmp_path / "ck"), statuses,
                          available_now=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("rule", "app_id", "fingerprint", "ts", "seq").collect()
    assert sorted(map(tuple, got), key=repr) == _brute(events, rules, statuses)


def test_status_of_issues(spark):
    events = _events(spark, 40)
    fp = {(r["app"]["app_id"], r["fingerprint"]) for r in RL.occurrences(events).select("app", "fingerprint").distinct().collect()}
    one, two, three = sorted(fp, key=repr)[:3]
    statuses = spark.createDataFrame([(*one, 1, "resolved"), (*two, 10**9, "resolved"), (*three, 1, "resolved"), (*three, 2, "ignored")], STATUS)
    got = {(r["app_id"], r["fingerprint"]): r["status"] for r in RL.issue_status(events, statuses).collect()}
    assert got[one] == "unresolved" and got[two] == "resolved" and got[three] == "ignored"
    assert {got[k] for k in fp - {one, two, three}} == {"unresolved"} and set(got) == fp


def test_any_window_of_the_tree_equals_the_full_order(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2, 3]), "t", rng.choice(["A", "B"]), rng.choice(["m", "n"]), rng.choice(["ENTER", "EXIT", "CATCH"]), 1000 + i, 5)
            for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, thread_id long, thread_name string, class_name string, method string, type string, "
                                     "ts long, duration_ms long")
    for scope in ("thread", "class"):
        tree = C.tree_rows(df, scope)
        full = [tuple(r) for r in tree.orderBy("sf", "cf", "level", "seq").collect()]
        for offset, limit, span in ((0, 7, 16), (50, 100, 16), (len(full) - 5, 50, 1 << 20), (10_000, 5, 16)):
            got = C.window_of_rows(tree, offset, limit, span).orderBy("pos").collect()
            assert [r["pos"] for r in got] == list(range(offset, min(offset + limit, len(full)))) if offset < len(full) else not got
            assert [tuple(r)[:-1] for r in got] == full[offset:offset + limit]


def test_a_batch_of_rules_looks_at_the_store_once(spark, tmp_path, monkeypatch):
    events, rules = _events(spark), _rules(spark)
    looks, read = [], LV.read_events
    monkeypatch.setattr(LV, "read_events", lambda *a: looks.append(a) or read(*a))
    ST.append_events(events, str(tmp_path / "t"), load_id=1)
    LV.live_rules(spark, str(tmp_path / "t"), rules, str(tmp_path / "out"), str(tmp_path / "ck"), _statuses(spark, events),
                  available_now=True).awaitTermination()
    assert len(looks) == 2  # the new loads, and the occurrences of their issues
    assert not list((tmp_path / "out" / "_work").glob("batch=*"))
    got = spark.read.parquet(str(tmp_path / "out")).select("rule", "app_id", "fingerprint", "ts", "seq").collect()
    assert sorted(map(tuple, got), key=repr) == _brute(events, rules, _statuses(spark, events))
