"""Operator 1, MinHash near-dedup by DartMinHash.

A document is its set of 5-word shingles, each of weight 1 however often it
stands there, as links are judged on sets.  For every shingle a Poisson process of darts lies on the plane weight x rank, drawn from
hashes of the shingle alone; the document owns the darts below its weight.  It
throws only the darts of rank below t / (total weight), about t in all whatever
its length, each of which falls on one of K coordinates; the dart of lowest
rank is that coordinate's signature.  Two documents agree on a coordinate with
the probability of their Jaccard similarity.

Copies of one word sequence are collapsed first (a pre-aggregated group-by on a
128-bit fingerprint), so the rest runs on distinct texts.  Signatures are cut
into bands.  In a bucket of equal bands no pairs are made: members are compared
with a few leaders, by the exact Jaccard similarity of their shingle sets.
Linked texts form components (alternating large-star and small-star steps); in
further rounds buckets that still hold several components get new leaders, until a
round adds no link.  What is left in buckets of several components is joined
exactly, by a prefix filter on the rarest shingles.  All joins are on keys of one bucket or document, and
large ones are left to Spark's skewed-join splitting.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from calltrail.llm.base import kept, mix64, text_chunks, windows, word_table

SHINGLE, SIMILARITY = 5, 0.8
#: 24 bands of 5: a pair of similarity 0.8 meets with probability 0.9999, one of 0.5 with 0.53.
BANDS, ROWS = 24, 5
#: Leaders that a bucket gets in a round.
LEADERS = 4
#: Bits of a set's parity map: two maps differ in at most as many bits as the sets in shingles.
PARITY = 512


def shingles(off: np.ndarray, data: np.ndarray):
    """(row, hash) of each run of SHINGLE words; a shorter text is one shingle."""
    rows, _, _, h = word_table(off, data)
    at, g = windows(rows, h, SHINGLE)
    out_rows = rows[at]
    n = np.bincount(rows, minlength=len(off) - 1)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        short = np.isin(rows, few)
        own, first = np.unique(rows[short], return_index=True)
        g = np.concatenate([g, np.add.reduceat(_placed(rows, h, n)[short], first)])
        out_rows = np.concatenate([out_rows, own])
    return rows, h, n, out_rows, g


def _placed(rows, h, n, salt=1):
    """Word hashes mixed with their position in the row."""
    first = np.cumsum(n) - n
    place = (np.arange(len(rows)) - first[rows]).astype(np.uint64)
    return mix64(h + (place + np.uint64(salt)) * np.uint64(0xD1342543DE82EF95))


def _row_sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson counts from uniforms, by the inverse of the distribution function."""
    top = int(mean + 12 * mean ** 0.5 + 12)
    k = np.arange(top)
    logs = k * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    return np.searchsorted(np.cumsum(np.exp(logs)), u, "right")


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def dart_signatures(rows: np.ndarray, g: np.ndarray, weight: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """(n_rows, k) signatures of weighted elements (row, hash, weight > 0).

    The plane is cut into regions [2^a, 2^a+1) x [2^b, 2^b+1) and [0, 1) on
    either axis; each element draws the number of darts of a region and their
    places from its hash.  A row that leaves a coordinate empty throws again
    with twice the rank, so every coordinate of a row with elements is filled.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n_rows * k, none)
    total = np.bincount(rows, weight, n_rows)
    limit = k * (np.log(k) + 4) / np.maximum(total, 1e-300)
    todo = np.ones(len(rows), bool)
    while todo.any():
        r, x, w = rows[todo], g[todo], weight[todo]
        reach = limit[r]
        a = 0
        while (low_w := 0.0 if a == 0 else 2.0 ** (a - 1)) < w.max(initial=0):
            b = 0
            heavy = np.flatnonzero(w > low_w)
            while (low_r := 0.0 if b == 0 else 2.0 ** (b - 1)) < reach[heavy].max(initial=0):
                wide_w, wide_r = max(low_w, 1.0), max(low_r, 1.0)
                own = heavy[reach[heavy] > low_r]
                seed = mix64(x[own] + np.uint64((a * 64 + b + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
                count = _poisson(_unit(seed), wide_w * wide_r)
                who = np.repeat(np.arange(len(own)), count)
                nth = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
                dart = mix64(seed[who] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))
                rank = low_r + wide_r * _unit(mix64(dart + np.uint64(1)))
                height = low_w + wide_w * _unit(mix64(dart + np.uint64(2)))
                ok = (height < w[own][who]) & (rank < reach[own][who])
                dart, rank, row = dart[ok], rank[ok], r[own][who][ok]
                at = row * k + (dart % np.uint64(k)).astype(np.int64)
                # rank above, the dart's name below: one minimum finds both
                value = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart >> np.uint64(32))
                np.minimum.at(best, at, value)
                b += 1
            a += 1
        empty = (best.reshape(n_rows, k) == none).any(1) & (total > 0)
        limit[empty] *= 2
        todo = empty[rows]
    return (best & np.uint64(0xFFFFFFFF)).reshape(n_rows, k)


def _sketch(docs: DataFrame, bands: int, per_band: int) -> DataFrame:
    """doc_id, n (distinct shingles), f1, f2 (fingerprint), bands (bucket keys)."""
    k = bands * per_band

    def run(batches):
        for b in batches:
            for at, off, data in text_chunks(b["text"], 1_000_000):
                n_rows = len(off) - 1
                rows, h, n, srow, g = shingles(off, data)
                key = mix64(g + srow.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                order = np.argsort(key)
                first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else order
                one = order[first]
                sig = dart_signatures(srow[one], g[one], np.ones(len(one)), n_rows, k).reshape(n_rows, bands, per_band)
                keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (n_rows, 1))
                for i in range(per_band):
                    keys = mix64(keys * np.uint64(0x2545F4914F6CDD1D) + sig[:, :, i])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n_rows + 1) * bands, pa.int32()),
                                                 pa.array(keys.reshape(-1).view(np.int64)))
                f1, f2 = (_row_sums(_placed(rows, h, n, s), n).view(np.int64) for s in (1, 77))
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(at, n_rows), pa.array(np.bincount(srow[one], minlength=n_rows), pa.int64()),
                     pa.array(f1), pa.array(f2), lists], ["doc_id", "n", "f1", "f2", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, s: the hashes of its distinct shingles, bits: their parity map."""
    def run(batches):
        for b in batches:
            for at, off, data in text_chunks(b["text"]):
                n_rows = len(off) - 1
                _, _, _, srow, g = shingles(off, data)
                order = np.lexsort((g, srow))
                srow, g = srow[order], g[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (srow[1:] != srow[:-1])
                ends = np.concatenate([[0], np.cumsum(np.bincount(srow[new], minlength=n_rows))])
                bits = np.zeros(n_rows * PARITY, np.uint8)
                np.bitwise_xor.at(bits, srow[new] * PARITY + (g[new] % np.uint64(PARITY)).astype(np.int64), np.uint8(1))
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(at, n_rows),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(g[new].view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(np.arange(n_rows + 1) * (PARITY // 64), pa.int32()),
                                              pa.array(np.packbits(bits).view(np.int64)))],
                    ["doc_id", "s", "bits"])

    return docs.mapInArrow(run, "doc_id long, s array<long>, bits array<long>")


def components(links: DataFrame) -> DataFrame:
    """(id, class): the least id of each connected component of links (u, v).

    Alternating large-star and small-star steps (Kiveris et al. 2014), each a
    pre-aggregated minimum and a join; the links are written out after a pair
    of steps, until they no longer change.
    """
    edges = kept(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written out, so that the join reads plain exchanges and a hub's links can be split between tasks
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = (both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = kept(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v"))).first()
        if now == state:
            break
        state = now
    stars = edges.groupBy("u").agg(F.min("v").alias("class"))
    return (stars.select(F.col("u").alias("id"), "class")
            .union(stars.select(F.col("class").alias("id"), "class").distinct()))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar enough."""
    # pairs and sets grow with the corpus: merge joins at every size
    left = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("s").alias("a")).hint("merge"), "u")
    both = left.join(sets.select(F.col("doc_id").alias("v"), F.col("s").alias("b")).hint("merge"), "v")
    common = F.size(F.array_intersect("a", "b"))
    return (both.select("u", "v", common.alias("c"), (F.size("a") + F.size("b")).alias("t"))
            .where(F.col("c") >= similarity * (F.col("t") - F.col("c")) - 1e-9).select("u", "v"))


def _remaining_links(docs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All links (u, v) between the classes of docs (doc_id, class), exactly.

    Shingles of one class link nothing, the others are ordered by how many docs
    hold them.  Linked sets share one of their first shingles in that order, the
    smaller set (a) among fewer of them; sizes, the places of the shared shingle
    and the parity maps bound what a pair can have in common.
    """
    own = docs.join(sets.hint("merge"), "doc_id")
    tokens = own.select("doc_id", "class", F.explode("s").alias("t"))
    common = (tokens.groupBy("t").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("f"))
              .where("low <> high").select("t", "f"))
    rare = (tokens.select("doc_id", "t").join(common.hint("merge"), "t")
            .groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("l")))
    least = lambda share, n: F.ceil(share * n - 1e-6)
    first = (own.select("doc_id", "class", "bits", F.size("s").alias("n")).join(rare.hint("merge"), "doc_id")
             .withColumn("first", (F.size("l") - least(similarity, F.col("n")) + 1).cast("int")).where("first > 0"))
    # rest: the shingles of the set from this one on
    first = kept(first.select("doc_id", "class", "bits", "n", F.size("l").alias("m"),
                              F.posexplode(F.slice(F.col("l.t"), F.lit(1), F.col("first"))).alias("place", "t"))
                 .select("t", "doc_id", "class", "bits", "n", (F.col("m") - F.col("place")).alias("rest")))
    share = 2 * similarity / (1 + similarity)
    a = first.where(F.col("rest") >= least(share, F.col("n"))).alias("a")
    b = first.alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    need = least(share / 2, n + m)
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col("a.bits")[i].bitwiseXOR(F.col("b.bits")[i]))
                                        for i in range(PARITY // 64)])
    pairs = (a.join(b.hint("merge"), (F.col("a.t") == F.col("b.t")) & (F.col("a.class") != F.col("b.class"))
                    & ((n < m) | (n == m) & (F.col("a.doc_id") < F.col("b.doc_id"))) & (n >= similarity * m - 1e-6)
                    & (F.least("a.rest", "b.rest") >= need) & (n + m - apart >= 2 * need))
             .select(F.greatest("a.doc_id", "b.doc_id").alias("u"), F.least("a.doc_id", "b.doc_id").alias("v")).distinct())
    return _verified(pairs, sets, similarity)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, per_band: int = ROWS,
                    leaders: int = LEADERS) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least doc_id of its
    class), kept (it is that document).

    A class holds the documents connected by links: the same words in the same
    order, or distinct 5-word shingles with a Jaccard similarity of at least
    `similarity` (texts under five words: one shingle).  Texts without words
    (null, empty) and null ids are classes of their own.  Rows that repeat a
    doc_id are one document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sketch = kept(_sketch(docs, bands, per_band))
    has = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    worded = sketch.where(has)
    texts = kept(worded.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"),
                                                F.first("bands").alias("bands")))
    rows = texts.select("rep", "n", F.explode("bands").alias("h"))
    shared = rows.groupBy("h").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("h")
    live = kept(rows.join(shared, "h"))
    wanted = live.select(F.col("rep").alias("doc_id")).distinct()
    # the list grows with the corpus: a merge join at every size, never a broadcast
    sets = kept(shingle_sets(docs.join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])))

    found, links, classes, turn = None, [], None, 0
    members = live.withColumn("class", F.col("rep"))
    while True:
        # linear in the bucket: each member meets `leaders` others
        def pick(i):
            return F.min(F.struct(F.xxhash64("rep", F.lit(turn * leaders + i)).alias("o"), F.col("rep").alias("v"),
                                  F.col("class").alias("c"), F.col("n").alias("m")))

        chosen = (members.groupBy("h")
                  .agg(F.min("class").alias("low"), F.max("class").alias("high"),
                       F.array(F.min(F.struct(F.col("rep").cast("long").alias("o"), F.col("rep").alias("v"),
                                              F.col("class").alias("c"), F.col("n").alias("m"))),
                               *[pick(i) for i in range(1, leaders)]).alias("leaders"))
                  .where("low <> high").select("h", "leaders"))
        pairs = (members.join(chosen, "h").select("rep", "class", "n", F.explode("leaders").alias("l"))
                 .where((F.col("class") != F.col("l.c"))
                        & (F.least("n", "l.m") >= similarity * F.greatest("n", "l.m") - 1e-9))
                 .select(F.greatest("rep", "l.v").alias("u"), F.least("rep", "l.v").alias("v")).distinct())
        found = kept(_verified(pairs, sets, similarity))
        if found.isEmpty():
            break
        links.append(found)
        classes = kept(components(reduce(DataFrame.union, links)))
        named = live.join(classes.select(F.col("id").alias("rep"), "class"), "rep", "left")
        members = kept(named.withColumn("class", F.coalesce("class", "rep")))
        turn += 1

    # two members of a bucket of which neither was a leader have not met; in one of two, one was
    mixed = (members.groupBy("h").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("size"))
             .where("low <> high and size > 2").select("h"))
    left = kept(members.join(mixed, "h").select(F.col("rep").alias("doc_id"), "class").distinct())
    found = kept(_remaining_links(left, sets, similarity))
    if not found.isEmpty():
        links.append(found)
        classes = kept(components(reduce(DataFrame.union, links)))

    named = texts.select("f1", "f2", "rep")
    if classes is not None:
        named = named.join(classes.select(F.col("id").alias("rep"), "class"), "rep", "left")
        named = named.select("f1", "f2", F.coalesce("class", "rep").alias("class_id"))
    else:
        named = named.select("f1", "f2", F.col("rep").alias("class_id"))
    out = (worded.select("doc_id", "f1", "f2").join(named, ["f1", "f2"]).select("doc_id", "class_id")
           .union(sketch.where(~has).select("doc_id", F.col("doc_id").alias("class_id"))))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
