"""Operator 12, filter interaction audit: min-plus removal ranks.

Filters that are applied one after another hide each other's work.  For every
order of the filters and every step: how many documents stay, are removed, would
have failed but were gone, and which labelled documents are lost.

What an order does to a document depends on the set of filters it fails alone.
With a mask matrix M (0 where the set holds the filter, else infinite) and the
inverse permutations P (the step at which an order applies a filter), the step that
removes a document is the min-plus product R[set, order] = min over filters of
M[set, filter] + P[order, filter].  All counts are linear in the number of
documents per failing set, so Spark counts those (32 per part), and each part's
counts are scattered over R in one small task.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

NAMES = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_REPORT = ("part string, filter_order string, step int, "
           + ", ".join(f"{c} long" for c in COUNTS))


def removal_steps(n_filters: int):
    """(orders, masks, R): all permutations (orders x filters), the failing sets
    (sets x filters, bool) by number, and R[set, order], the removing step
    from 1 (n_filters + 1: never removed)."""
    orders = np.array(list(permutations(range(n_filters))))
    masks = (np.arange(1 << n_filters)[:, None] >> np.arange(n_filters)) & 1 > 0
    never = n_filters + 1
    place = np.empty_like(orders)  # inverse permutations
    np.put_along_axis(place, orders, np.arange(1, never)[None, :], 1)
    plus = np.where(masks, 0, never)[:, None, :] + place[None, :, :]
    return orders, masks, np.minimum(plus.min(2), never)


def part_report(n: np.ndarray, good: np.ndarray, toxic: np.ndarray, n_filters: int) -> dict:
    """COUNTS (each orders x steps) from the documents per failing set."""
    orders, masks, r = removal_steps(n_filters)
    steps = n_filters + 2
    at = np.arange(len(orders))[None, :] * steps + r  # cell (order, removing step) of each set

    def scatter(weight):
        out = np.zeros(len(orders) * steps, np.int64)
        np.add.at(out, at.ravel(), np.repeat(weight, len(orders)))
        return out.reshape(len(orders), steps)[:, 1:-1]

    removed = scatter(n)
    fails = n @ masks                                     # per filter
    alone = n @ (masks & (masks.sum(1) == 1)[:, None])
    shapley = np.zeros(n_filters, np.int64)
    np.add.at(shapley, orders.ravel(), removed.ravel())
    return {"kept": n.sum() - removed.cumsum(1), "removed": removed, "redundant": fails[orders] - removed,
            "unique_fails": alone[orders], "good_lost": scatter(good), "toxic_lost": scatter(toxic),
            "shapley": shapley[orders]}


def audit(failures: DataFrame, names: str = NAMES) -> DataFrame:
    """The report over `failures`: part (string), mask (long, bit i: fails
    filter i), n, good, toxic (long counts).  Rows of one part and mask add up.

    One row per part, order and step, zeros included.  At most 2^filters counts
    of a part reach a task, and 8 filters at most are taken (40,320 orders).
    An empty table gives no rows.
    """
    k = len(names)
    if k > 8:
        raise ValueError("at most 8 filters")
    sets = (failures.groupBy("part", "mask")
            .agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
            .groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets")))

    def run(batches):
        orders = removal_steps(k)[0]
        label = np.array(["".join(names[i] for i in o) for o in orders])
        for b in batches:
            for row in b.to_pylist():
                counts = np.zeros((3, 1 << k), np.int64)
                for s in row["sets"]:
                    counts[:, s["mask"]] += (s["n"], s["good"], s["toxic"])
                found = part_report(*counts, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * orders.size), pa.array(np.repeat(label, k)),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))]
                    + [pa.array(found[c].ravel()) for c in COUNTS], ["part", "filter_order", "step", *COUNTS])

    return sets.mapInArrow(run, _REPORT)


def text_bits(text: Column) -> Column:
    """Bits 0-3: a text (not null) fails A (under 200 words), B (fewer than half
    of its words distinct), C (over 2 % of its code points in A-Z), D (one of #$%&*|)."""
    words = F.array_remove(F.split(text, r"[ \x09-\x0D]+"), "")
    n = F.size(words)
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n,
             F.lit(100).cast("long") * capitals > F.lit(2).cast("long") * F.char_length(text),
             text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, f in enumerate(fails)),
               F.lit(0).cast("long"))


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`failures` of the filters A-E over whole documents, by source.

    E fails a document whose text (by sha256) also stands under a smaller
    doc_id anywhere; among rows of the smallest id none fails, and rows
    without an id neither fail E nor make others fail.  A null text is an empty
    one, a null source the empty string.  A document is good (toxic) if any of
    its labels is 1; labels without an id or of other values say nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("fp"), text_bits(F.col("text")).alias("mask"))
    own = rows.groupBy("doc_id", "part", "fp", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"),
                            (F.col("toxic") == 1).alias("toxic"))
              .where("doc_id is not null and (good or toxic)")
              .groupBy("doc_id").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"),
                                     F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
              .withColumn("salt", F.lit(0).cast("long")))
    # rows without an id meet no label: they are dealt by text, not into one task
    own = own.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("fp")).otherwise(F.lit(0).cast("long")))
    own = own.join(marked.hint("merge"), ["doc_id", "salt"], "left").drop("salt").fillna(False, ["good", "toxic"])
    # copies collapse here, before anything is dealt by text
    copies = own.groupBy("fp", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"))
    first = copies.groupBy("fp").agg(F.min("least.doc_id").alias("first"))
    copies = copies.join(first, "fp")
    clear = F.col("no_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = copies.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), clear.alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(16).cast("long")).alias("mask"), (F.col("n") - clear).alias("n")))).alias("c"))
    return (split.select("part", "c.mask", "c.n", F.when(F.col("good"), F.col("c.n")).otherwise(0).alias("good"),
                         F.when(F.col("toxic"), F.col("c.n")).otherwise(0).alias("toxic")).where("n > 0"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A-E over `documents`."""
    return audit(document_failures(docs, labels))


#: DuckDB SQL for `filter_audit` over `documents` and `labels`.
SQL = r"""
WITH l AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), d AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS x FROM documents
), w AS (
  SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS lo FROM d
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(ws) < 200 AS a,
         100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
         100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 2 * length(x) AS c,
         regexp_matches(x, '[#$%&*|]') AS d, coalesce(lo < w.doc_id, false) AS e
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), g AS (
  SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), k AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k
), o AS (
  SELECT concat(k1.k, k2.k, k3.k, k4.k, k5.k) AS filter_order FROM k k1, k k2, k k3, k k4, k k5
  WHERE k2.k <> k1.k AND k3.k NOT IN (k1.k, k2.k) AND k4.k NOT IN (k1.k, k2.k, k3.k)
    AND k5.k NOT IN (k1.k, k2.k, k3.k, k4.k)
), r AS (
  SELECT g.*, filter_order, step, substr(filter_order, step, 1) AS letter,
         least(CASE WHEN a THEN strpos(filter_order, 'A') END, CASE WHEN b THEN strpos(filter_order, 'B') END,
               CASE WHEN c THEN strpos(filter_order, 'C') END, CASE WHEN d THEN strpos(filter_order, 'D') END,
               CASE WHEN e THEN strpos(filter_order, 'E') END) AS gone
  FROM g, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
), t AS (
  SELECT *, CASE letter WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
         a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails FROM r
), s AS (
  SELECT part, filter_order, step, letter,
         sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails AND gone < step THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM t GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM s
"""
