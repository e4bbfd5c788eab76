"""Operator 5, exact top-k search: pivot-table elimination.

Vectors become integers floor(scale * x); the score is their integer inner
product.  Distances to a few dozen pivots are computed once per vector.  By the
triangle inequality, |d(q, p) - d(x, p)| bounds the distance of query and
candidate from below for every pivot p, so the largest bound gives

    <q, x> <= (|q|^2 + |x|^2 - bound^2) / 2.

Candidates are evaluated in the order of this bound, until the next bound is
below the k-th best score: the rest cannot enter, so the result is exact.

Queries and candidates meet in blocks: both are dealt into groups by a hash of
their id, and a grouped task holds one group of each, so its memory is bounded by
the block sizes whatever the table's.  Each pair of groups keeps its k best
per query, and one pre-aggregated step merges them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

SCALE, PIVOTS = 256, 24
#: Rows of a group of queries and of candidates, about.
QUERY_BLOCK, BLOCK = 1_000, 20_000


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v, dim): floor(scale * x) as longs; vectors that are null, empty or
    hold null or non-finite components take no part.  A component whose product
    does not fit a long is an error."""
    x = F.transform(vec_col, lambda c: c.cast("double"))
    ok = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.col(id_col).isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = lambda c: F.when(F.abs(c * scale) < F.lit(2.0 ** 63), F.floor(c * scale).cast("long")).otherwise(
        F.raise_error(F.lit("a vector component does not fit a long")).cast("long"))
    return (vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"),
                                     F.transform(x, whole).alias("v"), F.size(vec_col).alias("dim")))


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, pivots: np.ndarray, k: int,
           first: int = 64):
    """Exact top k of x for each row of q: (query row, candidate row, score).
    Products that may leave 64 bits are taken in Python's integers; a score of
    the result that does not fit raises OverflowError."""
    qf, xf = q.astype(float), x.astype(float)
    qq, xx = (qf ** 2).sum(1), (xf ** 2).sum(1)
    away = lambda a, aa: np.sqrt(np.maximum(aa[:, None] - 2 * a @ pivots.T + (pivots ** 2).sum(1), 0))
    dq, dx = away(qf, qq).astype(np.float32), away(xf, xx).astype(np.float32)
    gap = np.zeros((len(q), len(x)), np.float32)
    for p in range(len(pivots)):
        np.maximum(gap, np.abs(dq[:, p, None] - dx[None, :, p]), out=gap)
    # give way by more than the rounding of float32 distances, and of the differences that they are roots of
    far = qq.max(initial=0) + xx.max(initial=0) + (pivots ** 2).sum(1).max(initial=0)
    slack = 4e-7 * (dq.max(1)[:, None] + dx.max(1)[None, :]) + 1e-7 * np.sqrt(far * q.shape[1] ** 0.5)
    both = qq[:, None] + xx[None, :]
    bound = (both - np.maximum(gap - slack, 0).astype(float) ** 2) / 2 + 1 + 1e-13 * both
    out = []
    most = float(np.abs(qf).max(initial=0)) * float(np.abs(xf).max(initial=0)) * q.shape[1]
    exact, wide = most < 2 ** 52, most >= 2 ** 62
    for i in range(len(q)):
        own = x_ids == q_ids[i]
        bound[i, own] = -np.inf
        left, at, size = len(x) - int(own.sum()), 0, min(first, len(x))
        order = None
        best_s, best_r = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while at < left:
            size = min(size, left - at)
            if order is None:  # the head is enough more often than not: sort the rest only when asked
                head = np.argpartition(-bound[i], size - 1)[:size] if size < len(x) else np.arange(len(x))
                rows = head[np.argsort(-bound[i, head], kind="stable")][:size]
                order = False
            else:
                if order is False:
                    order = np.argsort(-bound[i], kind="stable")
                    done = np.zeros(len(x), bool)
                    done[rows] = True
                    order = np.concatenate([rows, order[~done[order]]])
                rows = order[at:at + size]
            s = ((xf[rows] @ qf[i]).astype(np.int64) if exact else x[rows] @ q[i] if not wide
                 else x[rows].astype(object) @ q[i].astype(object))
            best_s, best_r = np.concatenate([best_s, s]), np.concatenate([best_r, rows])
            keep = np.lexsort((x_ids[best_r], -best_s))[:k]
            best_s, best_r = best_s[keep], best_r[keep]
            at += size
            if at < left and len(best_s) == k:
                rest = bound[i, order[at]] if order is not False else np.partition(
                    bound[i], len(x) - at - 1)[len(x) - at - 1]
                if rest < float(best_s[-1]):  # an equal bound could still tie
                    break
            size *= 4
        if any(not -2 ** 63 <= v < 2 ** 63 for v in best_s.tolist()):
            raise OverflowError("a score does not fit a long")
        out.append((np.full(len(best_r), i), best_r, best_s.astype(np.int64)))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """The k best of `vectors` for each row of `queries`: query_id, rank (from
    1), vec_id, score.  A row is no candidate of its own id; ties go to the
    smaller vec_id.  Only vectors of the query's length are compared; a query
    without candidates has no rows.  Rows that repeat an id are one vector each: each
    may appear in a result, and each row of `queries` has a result of its own.

    Pivots are the `pivots` vectors of each length with the smallest hash of
    their id, so the table is the same on every run.
    """
    x, q = integers(vectors, id_col, vec_col, scale), integers(queries, id_col, vec_col, scale)
    # rows that repeat an id are queries of their own: a result belongs to a row
    x, q = x.withColumn("row", F.lit(0).cast("long")), q.withColumn("row", F.monotonically_increasing_id())
    w = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id")
    # spread in two steps: a group limit inside each task comes before the shuffle
    chosen: dict[int, list] = {}
    for r in x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= pivots).collect():
        chosen.setdefault(r["dim"], []).append(r["v"])  # `pivots` vectors of each length
    n_x, n_q = x.groupBy("dim").count(), q.groupBy("dim").count()
    sizes = {r["dim"]: (r["a"], r["b"]) for r in n_x.withColumnRenamed("count", "a").join(
        n_q.withColumnRenamed("count", "b"), "dim").collect()}
    groups = {d: (-(-a // block), -(-b // query_block)) for d, (a, b) in sizes.items()}
    if not groups:
        return q.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id",
                        F.lit(0).cast("long").alias("score")).where("false")

    def dealt(df, of, other, name):
        mine = F.create_map(*[F.lit(z) for d, g in groups.items() for z in (d, g[of])])
        theirs = F.create_map(*[F.lit(z) for d, g in groups.items() for z in (d, g[other])])
        return (df.where(F.col("dim").isin(*groups))
                .select("vec_id", "row", "v", "dim", F.pmod(F.xxhash64("vec_id", F.lit(5)), mine[F.col("dim")]).alias(name),
                        F.explode(F.sequence(F.lit(0).cast("long"), theirs[F.col("dim")].cast("long") - 1))
                        .alias("b" if name == "a" else "a")))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        cut = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(len(t), dim)
        xs, qs = left, right
        if not len(xs) or not len(qs):
            i = j = s = np.zeros(0, np.int64)
            xi = qi = row = np.zeros(0, np.int64)
        else:
            xi, qi, row = xs["vec_id"].to_numpy(), qs["vec_id"].to_numpy(), qs["row"].to_numpy()
            parts = []
            for at in range(0, len(qi), 100):
                i, j, s = search(cut(qs)[at:at + 100], qi[at:at + 100], cut(xs), xi, np.array(chosen[dim], float), k)
                parts.append((i + at, j, s))
            i, j, s = [np.concatenate(c) for c in zip(*parts)]
        return pa.table({"query_id": qi[i], "vec_id": xi[j], "score": s.astype(np.int64),
                         "row": row[i]})

    a, b = dealt(x, 0, 1, "a"), dealt(q, 1, 0, "b")
    found = (a.groupBy("dim", "a", "b").cogroup(b.groupBy("dim", "a", "b"))
             .applyInArrow(run, "query_id long, vec_id long, score long, row long"))
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
