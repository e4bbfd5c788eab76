"""C1/C2 property tests: the chunked-scan pairing equals a literal stack
on random sequences, for several chunk spans (so hot keys crossing chunk
borders are covered); C4/C5 equal a literal tree walk."""

import random

import pytest
from pyspark.sql import functions as F

from calltrail.operators import calls as C
from calltrail.operators.scan import running_balance, running_sum
from calltrail.traceview import load_trace
from conftest import SMOKE


def literal_pairs(rows):
    """rows: (seq, thread, cls, meth, type) in seq order -> {enter: exit|None}, orphans."""
    stacks, pairs, orphans = {}, {}, set()
    for seq, th, cls, meth, typ in rows:
        st = stacks.setdefault(th, [])
        if typ == "ENTER":
            st.append((seq, cls, meth))
            pairs[seq] = None
        elif typ == "EXIT":
            idx = next((i for i in range(len(st) - 1, -1, -1) if st[i][1] == cls and st[i][2] == meth), -1)
            if idx >= 0:
                pairs[st[idx][0]] = seq
                st.pop(idx)
            else:
                orphans.add(seq)
    return pairs, orphans


def random_rows(rng, n):
    rows, seq = [], 0
    for _ in range(n):
        seq += rng.randint(1, 3)
        rows.append((seq, rng.randint(1, 2), rng.choice(["A", "B"]), rng.choice(["m", "n"]),
                     rng.choice(["ENTER", "ENTER", "EXIT", "EXIT", "CATCH"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(s, th, "t", c, m, t, s * 10, None) for s, th, c, m, t in rows],
        "seq long, thread_id long, thread_name string, class_name string, method string, type string, "
        "ts long, duration_ms long")


@pytest.mark.parametrize("span", [1, 2, 5, 1 << 20])
def test_pairing_matches_literal_stack(spark, span):
    rng = random.Random(span)
    rows = []
    for _ in range(6):
        rows += random_rows(rng, 60)
        rows = [(i + 1, *r[1:]) for i, r in enumerate(rows)]
    df = frame(spark, rows)
    lab = C.label_calls(df, "thread", chunk_span=span).collect()
    got_pairs = {r["seq"]: r["partner_seq"] for r in lab if r["type"] == "ENTER"}
    got_orph = {r["seq"] for r in lab if r["type"] == "EXIT" and r["orphan"]}
    exp_pairs, exp_orph = literal_pairs(rows)
    assert got_pairs == exp_pairs
    assert got_orph == exp_orph


@pytest.mark.parametrize("span", [1, 3, 1 << 20])
def test_scans_match_plain_windows(spark, span):
    rng = random.Random(7)
    data = [(rng.choice(["k1", "k2", "k3"]), i, rng.randint(-3, 3)) for i in range(200)]
    df = spark.createDataFrame(data, "k string, o long, v long")
    got = {r["o"]: r for r in running_balance(df, ["k"], "o", "v", chunk_span=span).collect()}
    runs = {r["o"]: r["run"] for r in running_sum(df, ["k"], "o", "v", chunk_span=span, out="run").collect()}
    for k in ("k1", "k2", "k3"):
        of_key = [(o, v) for kk, o, v in data if kk == k]
        bal = [sum(v for _, v in of_key[:i + 1]) for i in range(len(of_key))]
        for i, (o, _) in enumerate(of_key):
            assert got[o]["bal"] == runs[o] == bal[i]
            assert got[o]["floor"] == min([0, *bal[:i]])
            assert got[o]["later_min"] == min(bal[i + 1:], default=None)


def literal_tree(events, scope_key):
    """Pre-order (kind, what, depth), from the definition: an EXIT takes the latest
    earlier ENTER of its (scope, class, method) that no EXIT took before; groups stand
    in the order of their first event."""
    def key(e):
        return scope_key(e), e["class_name"], e["method"]

    taken, orphans = set(), set()
    for x in (e for e in events if e["type"] == "EXIT"):
        free = [e["seq"] for e in events if e["type"] == "ENTER" and key(e) == key(x)
                and e["seq"] < x["seq"] and e["seq"] not in taken]
        if free:
            taken.add(max(free))
        else:
            orphans.add(x["seq"])
    out = []
    for scope in dict.fromkeys(scope_key(e) for e in events):
        own = [e for e in events if scope_key(e) == scope]
        base = 0 if scope is None else 1
        if base:
            out.append(("scope", scope, 0))
        for cls in dict.fromkeys(e["class_name"] for e in own):
            out.append(("component", cls, base))
            out += [("call" if e["type"] == "ENTER" else "leaf", e["seq"], base + 1) for e in own
                    if e["class_name"] == cls and (e["type"] != "EXIT" or e["seq"] in orphans)]
    return out


@pytest.mark.parametrize("scope", ["thread", "class", "manufacturer", "device", "session", "device_id"])
def test_tree_preorder_matches_literal_walk(spark, scope):
    t = load_trace(spark, SMOKE)
    rows = C.tree_rows(t, scope, chunk_span=37).orderBy("sf", "cf", "level", "seq").collect()
    got = []
    for r in rows:
        if r["kind"] == "scope":
            got.append(("scope", r["scope"], r["depth"]))
        elif r["kind"] == "component":
            got.append(("component", r["class_name"], r["depth"]))
        else:
            got.append((r["kind"], r["seq"], r["depth"]))
    evs = [r.asDict() for r in t.orderBy("seq").collect()]
    key = {
        "thread": lambda e: str(e["thread_id"]),
        "class": lambda e: None,
        "manufacturer": lambda e: e["device_manufacturer"] or "(unknown)",
        "session": lambda e: e["session_id"] if e["session_id"] is not None else "(unknown)",
        "device_id": lambda e: e["device_id"] if e["device_id"] is not None else "(unknown)",
        "device": lambda e: (f"{e['device_model']} ({e['tag']})" if e["tag"] and e["device_model"]
                             else e["tag"] or e["device_model"] or "(unknown)"),
    }[scope]
    assert got == literal_tree(evs, key)


def test_collapsed_nodes_hide_children(spark):
    t = load_trace(spark, SMOKE)
    full = C.tree_rows(t, "thread")
    first_scope = full.where(F.col("kind") == "scope").orderBy("sf").first()["scope"]
    hidden = C.tree_rows(t, "thread", collapsed_scopes=[first_scope])
    assert hidden.where((F.col("scope") == first_scope) & (F.col("level") > 0)).count() == 0
    assert hidden.where(F.col("scope") == first_scope).count() == 1


def test_hot_key_is_split_across_tasks(spark):
    """One (thread, class, method) key with every row: each exchange feeding
    the per-key windows partitions by the key *and* its seq chunk, so the
    key is spread over its chunks' tasks; the pairing stays exact."""
    import re
    rng = random.Random(11)
    rows = [(i + 1, 0, "main", "Hot", "run", rng.choice(["ENTER", "EXIT"])) for i in range(4000)]
    df = spark.createDataFrame([(*r, (r[0]) * 10, None) for r in rows],
                               "seq long, thread_id long, thread_name string, class_name string, method string, "
                               "type string, ts long, duration_ms long")
    lab = C.label_calls(df, "thread", chunk_span=250)
    got = lab.collect()
    plan = lab._jdf.queryExecution().executedPlan().toString()
    specs = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", plan)
    row_windows = [w for w in specs if re.search(r"seq#\d+L? ASC", w)]  # windows over rows, in seq order
    # the one window without a chunk holds the ends of calls that cross a chunk
    # border: at most two rows a chunk in each of its groups
    assert row_windows and all("__chunk#" in w or "__v#" in w for w in row_windows)
    assert [w for w in row_windows if "__chunk#" in w]
    crossing = [r for r in got if r["partner_seq"] and r["seq"] // 250 != r["partner_seq"] // 250]
    ends = {}
    for r in crossing:
        group = ends.setdefault((r["bal"] + (r["type"] == "EXIT"), r["seq"] // 250), [])
        group.append(r["seq"])
    assert crossing and max(len(g) for g in ends.values()) <= 2
    assert lab.select(F.floor(F.col("seq") / 250)).distinct().count() == 17  # seq 1..4000
    exp_pairs, exp_orph = literal_pairs([(s, th, c, m, t) for s, th, _, c, m, t in rows])
    assert {r["seq"]: r["partner_seq"] for r in got if r["type"] == "ENTER"} == exp_pairs
    assert {r["seq"] for r in got if r["orphan"]} == exp_orph
