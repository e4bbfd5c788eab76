"""Plan checks: pure operators run no Python; windows
are partitioned (except the page's bounded one); the store query prunes day
partitions and pushes filters into the scan; top-N per user is limited
map-side."""

import re

import pytest

from calltrail.operators import filters as FL
from calltrail.operators import insights as IN
from calltrail.plans.catalog import QUERIES
from calltrail.sources import store as ST
from calltrail.traceview import load_trace
from conftest import SMOKE

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "FlatMapGroupsInPandasWithState", "PythonUDF")
# Queries whose operators are allowed Python workers or that
# run a stream (planned per micro-batch).
PYTHON_OK = {"bodies", "live_pairs", "live_stats", "live_quota", "live_apps", "live_labels"}
BOUNDED_GLOBAL_WINDOW = {"page", "store_page"}  # window over the <= 5001-row page only


def executed_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def unpartitioned_windows(plan: str) -> list[str]:
    """Window specs whose first argument is already an ordering or a frame,
    i.e. windows without PARTITION BY (one task for all rows)."""
    out = []
    for m in re.finditer(r"windowspecdefinition\(([^,)]*)", plan):
        first = m.group(1)
        if " ASC NULLS" in first or " DESC NULLS" in first or first.startswith("specifiedwindowframe"):
            out.append(first)
    return out


# The catalogue's own queries; the training-data operators may use Python workers.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON_OK))
def test_pure_plans(spark, name):
    df = QUERIES[name](spark, SMOKE)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    for node in PYTHON_NODES:
        assert node not in plan, f"{name} runs Python: {node}"
    if name in BOUNDED_GLOBAL_WINDOW:
        assert unpartitioned_windows(plan), "page numbering expected on the bounded page"
    else:
        assert not unpartitioned_windows(plan), f"{name} has a window without PARTITION BY"


def test_store_query_prunes_partitions(spark, tmp_path):
    table = str(tmp_path / "store")
    ST.append_events(load_trace(spark, SMOKE), table, load_id=1)
    ev = ST.read_events(spark, table)
    q = FL.store_query(ev, since=1704844800000, until=1705449600000, app_id="com.example.app1")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "PushedFilters: [IsNotNull(ts), IsNotNull(app_id), GreaterThan(ts,1704844800000)" in plan
    days = {r["event_date"] for r in q.select("event_date").distinct().collect()}
    assert days and all("2024-01-10" <= str(d) <= "2024-01-17" for d in days)


def test_timeline_limits_map_side(spark):
    t = IN.timeline(load_trace(spark, SMOKE), 20)
    plan = executed_plan(t.select("user_id", "seq"))
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("name,most", [("call_durations", 6), ("open_calls", 5), ("call_pairs", 9)])
def test_pairing_shuffles_few_and_narrow_rows(spark, name, most):
    """ENTER / EXIT rows are cut to the columns pairing needs before any
    exchange by key, nothing is cached, and the exchanges are counted."""
    qe = QUERIES[name](spark, SMOKE)._jdf.queryExecution()
    plan = qe.sparkPlan().toString() + qe.executedPlan().toString()
    assert "InMemoryRelation" not in plan and "InMemoryTableScan" not in plan
    keyed = [x for x in re.findall(r"Exchange hashpartitioning\(([^\n]*)", qe.executedPlan().toString())]
    assert 0 < len(keyed) <= most
    for line in qe.optimizedPlan().toString().splitlines():
        if "Window [" in line:
            assert not re.search(r"message#|stack#|exception#|params#|app_version#", line)
