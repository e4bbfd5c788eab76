"""Print the formatted physical plan of catalogue queries.

Usage: python -m calltrail.plans.explain [sf_dir] name [name ...]

Shows what the design notes claim: pushed filters and read schemas at the
scan, exchanges keyed by (key, chunk) in call pairing, WindowGroupLimit in
timelines, no Python nodes outside S2 and T7.
"""

from __future__ import annotations

import sys


def explain(spark, name: str, sf_dir: str, mode: str = "formatted") -> str:
    from calltrail.plans.catalog import QUERIES
    df = QUERIES[name](spark, sf_dir)
    return df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def main(argv):
    from calltrail.session import get_spark
    args = argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and "/" in args[0]:
        sf_dir, args = args[0], args[1:]
    spark = get_spark()
    for n in args:
        print(f"===== {n} =====")
        print(explain(spark, n, sf_dir))


if __name__ == "__main__":
    main(sys.argv)
