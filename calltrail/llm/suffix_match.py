"""Operator 11, benchmark decontamination by training suffix arrays.

Training texts are cut into shards (one Arrow batch each); a shard has a suffix
array over its words.  Every test suffix that starts a window (10 consecutive
words of an item; an item of fewer words is one window) is binary-searched in
every shard, word by word: the range left after a whole window holds all its occurrences,
and the place where the search ends gives the longest verbatim match of each
training position, by comparing neighbours.

Only stretches of a shard whose runs of three words all occur in some item are
put into its array, with the one word after them that can still decide an order:
no test suffix can match anywhere else.  Words are 63-bit hashes.

Items are the query set.  They reach the tasks in blocks of at most BLOCK_WORDS
words, so neither the driver nor a task holds more; further blocks are further
passes over the texts, whose results are merged by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from calltrail.llm.base import kept, lower_az, mix64, text_chunks, word_table

WINDOW = 10
#: Item words (8 bytes each) that are broadcast at a time.
BLOCK_WORDS = 2_000_000
_HEAD = 3  # words of a window that the stretches are chosen by
_RESULT = ("__n_words long, __spans array<struct<start:long,end:long>>, __items array<string>, "
           "__longest struct<words:long,at:long,item:string>")


def words_of(off: np.ndarray, data: np.ndarray):
    """(row, hash) of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after
    lower-casing A-Z; hashes have the top bit set, so smaller numbers are free."""
    data = lower_az(data)
    rows, _, _, h = word_table(off, data, (data >= 0x80) | (data >= 48) & (data <= 57) | (data >= 97) & (data <= 122))
    return rows, h | np.uint64(1 << 63)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of the suffixes, which are compared over
    `depth` words at least: prefix doubling."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    if not n:
        return order
    k = 1
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (text[order][1:] != text[order][:-1]).astype(np.int64)]))
    while k < min(depth, n) and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[:n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        own = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (own[1:] != own[:-1]).astype(np.int64)]))
        k *= 2
    return order


def _heads(text: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on (the last k - 1 places have none)."""
    g = np.zeros(max(len(text) - k + 1, 0), np.uint64)
    for i in range(k):
        g = mix64(g * np.uint64(0x2545F4914F6CDD1D) + text[i:i + len(g)])
    return g


class Tests:
    """The test suffixes of one block of items, in suffix order."""

    def __init__(self, rows: list[tuple[str, np.ndarray]], window: int = WINDOW):
        """rows: (item id, hashes of its words)."""
        rows = sorted(rows, key=lambda r: r[0])
        words = [np.asarray(w, np.uint64) for _, w in rows]
        self.items = sorted({i for i, _ in rows})
        number = np.searchsorted(np.array(self.items, object), np.array([i for i, _ in rows], object)) if rows else []
        self.text = np.concatenate([x for w in words for x in (w, np.zeros(1, np.uint64))]
                                   + [np.zeros(1, np.uint64)])
        size = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(size + 1) - size - 1
        at, left, item = [], [], []
        for i in np.flatnonzero(size):
            n = max(int(size[i]) - window, 0) + 1
            at.append(first[i] + np.arange(n)), left.append(size[i] - np.arange(n)), item.append(np.full(n, number[i]))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        at, left, item = cat(at), cat(left), cat(item)
        self.depth = int(left.max(initial=0))
        place = np.empty(len(self.text), np.int64)
        place[suffix_array(self.text, self.depth + 1)] = np.arange(len(self.text))
        by = np.argsort(place[at], kind="stable")
        self.at, self.left, self.item = at[by], left[by], item[by]
        self.size = np.minimum(self.left, window)
        # equal windows are neighbours in suffix order, and are searched once
        new = np.ones(len(by), bool)
        new[1:] = self.size[1:] != self.size[:-1]
        for d in range(window):
            a = np.where(d < self.size, self.text[np.minimum(self.at + d, len(self.text) - 1)], 0)
            new[1:] |= a[1:] != a[:-1]
        self.window = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        ids = len(self.items) + 1
        pairs = np.unique(self.window * ids + self.item)
        self.item_of = pairs % ids
        self.item_from = np.searchsorted(pairs // ids, np.arange(len(self.first) + 1))
        # what a stretch is made of: every run of 3 item words (an item of 1 or 2: all of it)
        bits = min(max(int(16 * len(self.text)).bit_length(), 12), 26)
        self.shift = np.uint64(64 - bits)
        self.head = {}
        run = np.minimum(size, min(_HEAD, window))
        for k in set(run[run > 0].tolist()):
            own = np.concatenate([first[i] + np.arange(size[i] - k + 1) for i in np.flatnonzero(run == k)])
            self.head[k] = np.zeros(1 << bits, bool)
            self.head[k][(_heads(self.text, k)[own] >> self.shift).astype(np.int64)] = True

    def stretches(self, rows: np.ndarray, h: np.ndarray):
        """Indexes of the words that may be in a window or come after one."""
        keep = np.zeros(len(h) + _HEAD + 1, np.int8)
        for k, seen in self.head.items():
            g = _heads(h, k)
            hit = np.flatnonzero(seen[(g >> self.shift).astype(np.int64)] & (rows[:len(g)] == rows[k - 1:]))
            for d in range(_HEAD + 1):
                keep[hit + d] = 1
        return np.flatnonzero(keep[:len(h)])


def search(tests: Tests, text: np.ndarray, sa: np.ndarray):
    """Of each test suffix: the range of `sa` that starts with its window, and
    its place in the order of `sa`."""
    n = len(tests.at)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(sa), np.int64)
    found = np.zeros((n, 2), np.int64)
    live = np.arange(n) if len(sa) else np.zeros(0, np.int64)
    d = 0

    def bound(a, b, want, after):
        a, b = a.copy(), b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            have = text[np.minimum(sa[mid] + d, len(text) - 1)]
            down = (have <= want[open_]) if after else (have < want[open_])
            a[open_] = np.where(down, mid + 1, a[open_])
            b[open_] = np.where(down, b[open_], mid)
            open_ = open_[a[open_] < b[open_]]
        return a

    while len(live):
        whole = live[tests.size[live] == d]
        found[whole, 0], found[whole, 1] = lo[whole], hi[whole]
        live = live[tests.left[live] > d]
        want = tests.text[tests.at[live] + d]
        a, b = lo[live], hi[live]
        lo[live], hi[live] = bound(a, b, want, False), bound(a, b, want, True)
        live = live[lo[live] < hi[live]]
        d += 1
    return found[:, 0], found[:, 1], lo


def _same(text, at, tests, which):
    """Words that each text position has in common with the test suffix beside it."""
    out = np.zeros(len(at), np.int64)
    live = np.flatnonzero(which >= 0)
    d = 0
    while len(live):
        ok = (tests.left[which[live]] > d) & (at[live] + d < len(text))
        live = live[ok]
        live = live[text[at[live] + d] == tests.text[tests.at[which[live]] + d]]
        d += 1
        out[live] = d
    return out


def _match_rows(column, tests: Tests):
    """Per row of an Arrow text column: words, hit spans, items, longest match."""
    m = len(column)
    n_words = np.zeros(m, np.int64)
    text, where, place = [], [], []
    for first, off, data in text_chunks(column, 4_000_000):
        rows, h = words_of(off, data)
        n_words[first:first + len(off) - 1] = np.bincount(rows, minlength=len(off) - 1)
        if tests.head:
            i = tests.stretches(rows, h)
            text.append(h[i]), where.append(rows[i] + first), place.append(i - np.searchsorted(rows, rows[i]))
    spans, items, longest = [[] for _ in range(m)], [[] for _ in range(m)], [None] * m
    if not text or not sum(map(len, text)):
        return n_words, spans, items, longest
    text, where, place = map(np.concatenate, (text, where, place))
    # an end mark (a number of its own, below all words) after each stretch
    new = np.flatnonzero((where[1:] != where[:-1]) | (place[1:] != place[:-1] + 1)) + 1
    mark = np.arange(1, len(new) + 2, dtype=np.uint64)
    at = np.append(new, len(text))
    text = np.insert(text, at, mark)
    where, place = np.insert(where, at, -1), np.insert(place, at, -1)
    sa = suffix_array(text, tests.depth + 1)
    lo, hi, ins = search(tests, text, sa)

    # occurrences of every distinct window
    lo, hi, size = lo[tests.first], hi[tests.first], tests.size[tests.first]
    count = hi - lo
    win = np.repeat(np.arange(len(count)), count)
    pos = sa[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[win]]
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, pos, 1)
    np.add.at(cover, pos + size[win], -1)
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    if not len(hit):
        return n_words, spans, items, longest
    cut = np.flatnonzero((where[hit][1:] != where[hit][:-1]) | (place[hit][1:] != place[hit][:-1] + 1))
    begin, end = hit[np.append(0, cut + 1)], hit[np.append(cut, len(hit) - 1)]
    for r, a, b in zip(where[begin].tolist(), place[begin].tolist(), place[end].tolist()):
        spans[r].append({"start": a, "end": b + 1})
    pair = np.unique(where[pos] * len(count) + win)
    row, win = pair // len(count), pair % len(count)
    number = tests.item_from[win + 1] - tests.item_from[win]
    item = tests.item_of[np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                         + np.repeat(tests.item_from[win], number)]
    pair = np.unique(np.repeat(row, number) * (len(tests.items) + 1) + item)
    row, item = pair // (len(tests.items) + 1), pair % (len(tests.items) + 1)
    edge = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row))
    for a, b in zip(edge[:-1], edge[1:]):
        items[row[a]] = [tests.items[i] for i in item[a:b]]

    # the longest match of a position is one with the test suffix before or after it
    start = np.unique(pos)
    back = np.empty(len(sa), np.int64)
    back[sa] = np.arange(len(sa))
    after = np.searchsorted(ins, back[start], "right")
    best, who = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    for near in (after - 1, np.where(after < len(ins), after, -1)):
        n = _same(text, start, tests, near)
        who, best = np.where(n > best, near, who), np.maximum(best, n)
    by = np.lexsort((place[start], -best, where[start]))
    top = by[np.append(True, where[start][by][1:] != where[start][by][:-1])]
    for r, n, a, t in zip(where[start[top]].tolist(), best[top].tolist(), place[start[top]].tolist(), who[top].tolist()):
        longest[r] = {"words": n, "at": a, "item": tests.items[tests.item[t]]}
    return n_words, spans, items, longest


def item_words(items: DataFrame) -> DataFrame:
    """(item, words): the hashed words of every item that has some.  A null
    item_id is the empty string; equal rows count once."""
    def run(batches):
        for b in batches:
            for at, off, data in text_chunks(b["text"]):
                rows, h = words_of(off, data)
                ends = np.searchsorted(rows, np.arange(len(off)))
                words = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b["item"].slice(at, len(off) - 1), words], ["item", "words"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
    return named.distinct().mapInArrow(run, "item string, words array<long>").where(F.size("words") > 0)


def _marked(rows: DataFrame, text: str, tests, out: list[str]) -> DataFrame:
    """rows (safe column names) with the results of one block appended."""
    fields = [f for f in rows.schema.fields if f.name in out]

    def run(batches):
        for b in batches:
            n_words, spans, items, longest = _match_rows(b[text], tests.value)
            yield pa.RecordBatch.from_arrays(
                [b[c] for c in out] + [
                    pa.array(n_words), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(longest, pa.struct([("words", pa.int64()), ("at", pa.int64()), ("item", pa.string())]))],
                [*out, "__n_words", "__spans", "__items", "__longest"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), _RESULT])
    return rows.mapInArrow(run, schema)


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with all its columns and

    __n_words  words of the text
    __spans    disjoint word ranges [start, end) inside occurrences of windows
    __items    ids, sorted as strings, of the items with an occurring window
    __longest  the longest verbatim match with an item from such an occurrence on:
               its words, its first word in the text, the item (null: none)

    A null text has no words.  Items share a window if its words are equal.
    An item of over `block_words` words is a block by itself.  With more than one block,
    docs is written once to the shared folder with a row number.
    """
    spark = docs.sparkSession
    fields = docs.schema.fields
    names = [f"c{i}" for i in range(len(fields))]  # safe names: a table may hold clashing ones
    text = names[[f.name for f in fields].index("text")]
    plain = docs.toDF(*names)
    tests = kept(item_words(items))
    total = tests.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_words)) if total > block_words else 1
    results, final = ["__n_words", "__spans", "__items", "__longest"], [f.name for f in fields]

    def block(i):
        own = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == i)
        rows = own.toPandas()
        return spark.sparkContext.broadcast(Tests(
            [(i, np.asarray(w, np.int64).view(np.uint64)) for i, w in zip(rows["item"], rows["words"])], window))

    if blocks == 1:
        return _marked(plain, text, block(0), names).toDF(*final, *results)
    plain = kept(plain.withColumn("__row", F.monotonically_increasing_id()))
    parts = None
    for i in range(blocks):
        found = kept(_marked(plain.select("__row", text), text, block(i), ["__row"])
                     .where(F.lit(i == 0) | (F.size("__items") > 0)))
        parts = found if parts is None else parts.union(found)
    merged = parts.groupBy("__row").agg(
        F.max("__n_words").alias("__n_words"), F.array_sort(F.flatten(F.collect_list("__spans"))).alias("__spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"),
        F.max(F.struct(F.col("__longest.words").alias("words"), (-F.col("__longest.at")).alias("at"),
                       F.col("__longest.item").alias("item"))).alias("__longest"))
    merged = merged.withColumns({
        "__spans": F.expr(_DISJOINT),
        "__longest": F.expr("if(__longest.words is null, null, named_struct('words', __longest.words, "
                            "'at', -__longest.at, 'item', __longest.item))")})
    return plain.join(merged.hint("merge"), "__row").select(*names, *results).toDF(*final, *results)


#: Sorted, possibly overlapping spans as disjoint ones.
_DISJOINT = """aggregate(__spans, cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) ->
  if(size(a) > 0 and element_at(a, -1).end >= x.start,
     concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))),
     concat(a, array(x))))"""


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, and the longest match (longest_words, longest_at, longest_item).
    Items that stand twice under one id count once."""
    found = matched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, window, block_words)
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("__spans") > 0).alias("contaminated"),
        F.col("__longest.words").alias("longest_words"), F.col("__longest.at").alias("longest_at"),
        F.col("__longest.item").alias("longest_item"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with their columns, that hold no window of an item."""
    return (matched(docs, items, window).where(F.size("__spans") == 0)
            .drop("__n_words", "__spans", "__items", "__longest"))


#: DuckDB SQL for `report`'s columns that the window rule fixes.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text,
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), k AS (
  SELECT item, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0) t
), s AS (
  SELECT DISTINCT size FROM k
), o AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, s WHERE len(w) >= size) t
), m AS (
  SELECT r, i, o.size, item FROM o JOIN k ON o.size = k.size AND o.win = k.win
), h AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM m) x) y
  GROUP BY r
), g AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM m) x GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(g.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN g ON d.r = g.r
"""
