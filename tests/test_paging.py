"""L1 / L2 on tied timestamps (FIXTURES.md §3 'ties': 12 rows, 3 distinct
ts, page size 4)."""

from pyspark.sql import functions as F

from calltrail.operators import filters as FL
from calltrail.operators import paging as PG


def ties(spark):
    rows = [(i, "ENTER", 100 + (0 if i < 5 else 1 if i < 9 else 2)) for i in range(12)]
    return spark.createDataFrame(rows, "seq long, type string, ts long")


def test_ts_cursor_loses_tied_rows_pair_cursor_does_not(spark):
    df = ties(spark)
    seen, since = [], 0
    while True:  # the reference's walk: ts-only strict cursor
        p = PG.page(FL.store_query(df, since=since), limit=4).orderBy("page_pos").collect()
        seen += [r["seq"] for r in p]
        if not p or p[0]["next_cursor"] is None:
            break
        since = p[0]["next_cursor"]
    assert len(seen) < 12 and 4 not in seen  # row 4 (5th row with ts 100) is skipped

    got, cur = [], (0, -1)
    while True:  # (ts, seq) cursor: nothing lost
        batch = PG.after_cursor(df, cur[0], cur[1]).orderBy("ts", "seq").limit(4).collect()
        if not batch:
            break
        got += [r["seq"] for r in batch]
        cur = (batch[-1]["ts"], batch[-1]["seq"])
    assert got == list(range(12))
    assert PG.next_cursor(df).first()[:] == (102, 11)


def test_page_clamps_and_cursor(spark):
    df = ties(spark)
    assert PG.clamp_limit(0) == 1 and PG.clamp_limit(10_000) == 5000 and PG.clamp_limit(None) == 500
    p = PG.page(df, limit=0).collect()
    assert len(p) == 1 and p[0]["next_cursor"] == 100
    assert PG.page(df, limit=12).where(F.col("next_cursor").isNotNull()).count() == 0
    compat = PG.after_cursor(df, 100, 3, compat=True).count()
    assert compat == 7
