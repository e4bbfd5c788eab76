"""Operator 13, spelling variant grouping: a dictionary of trie-node pairs.

Every prefix of a word is a node of the forward trie of the vocabulary, every
suffix one of the reversed trie.  Nodes carry integers: 64-bit numbers made from
the letters on their path, so equal paths have equal numbers in every task and no
table of nodes is needed.  A word stands in the dictionary under

  skip at i   (node of w[:i], node of w[i+1:])   one per letter
  cut at i    (node of w[:i], node of w[i:])     one per gap

Words that share a skip differ in that one letter; a word whose cut is another's skip
lacks that one letter.  A word reaches the same neighbour by several gaps if
the letter stands in a run of its like; only the run's last place counts, so
each neighbour is met once.

Under one pair stand the words that have some letter there (at most one per
letter of the alphabet, 90) and the word without it: a group is bounded, and it yields
one row per member (neighbours, best neighbour), never pairs.  Words are
numbered by (n descending, word), so the best neighbour is the least number.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from calltrail.llm.base import _powers, kept, lower_az, mix64, text_chunks, word_table

MIN_LETTERS = 7
MIN_COUNT = 2
#: A form is at least so many times as frequent as the word.
RATIO = 10
#: One in so many (document, run) pairs loses a letter.
DELETE_ONE_IN = 31
_PAIRS = "p long, s long, kind int, r long"
_VALUES = 250_000  # dictionary rows of one Arrow batch


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def crc32_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes, going on from the crc32 `begun` of what
    stands before it.  Runs of over 64 bytes are done one by one."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    long = int((size > 64).sum())
    out = begun.astype(np.uint32)
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i]:ends[i]], int(out[i]))
    short = order[long:]
    table, c, at, left = _crc_table(), ~out[short], starts[short], size[short]
    for j in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -j, "left"))  # runs with a byte j come first
        c[:m] = table[(c[:m] ^ data[at[:m] + j]) & np.uint32(255)] ^ (c[:m] >> np.uint32(8))
    out[short] = ~c
    return out


def _runs(off: np.ndarray, data: np.ndarray):
    """Runs [A-Za-z\\u00C0-\\u00FF]+ with A-Z lower-cased: bytes, rows, first and
    end byte, hash, code points.  In UTF-8 those letters are one byte, or C3
    and one more."""
    data = lower_az(data)
    lead = data == 0xC3
    letter = (data >= 97) & (data <= 122) | lead
    letter[1:] |= lead[:-1]
    rows, starts, ends, h = word_table(off, data, letter)
    leads = np.concatenate([[0], np.cumsum(lead)])
    return data, rows, starts, ends, h, (ends - starts) - (leads[ends] - leads[starts])


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
                one_in: int = DELETE_ONE_IN) -> DataFrame:
    """(word, n): the words of whole texts with their occurrences.  One in
    `one_in` (document, run) pairs, by crc32 of "<doc_id>:<run>", loses the
    letter crc32 mod length.  A null id is empty text there; a null text has no words.
    Counts are added up in the task first, so a frequent word is one row of it.
    """
    def run(batches):
        for b in batches:
            for at, off, data in text_chunks(b["text"]):
                data, rows, starts, ends, h, letters = _runs(off, data)
                on = np.flatnonzero(letters >= min_letters)
                rows, starts, ends, h, letters = rows[on], starts[on], ends[on], h[on], letters[on]
                begun = np.array([zlib.crc32(f"{k}:".encode()) for k in b["key"].slice(at, len(off) - 1).to_pylist()], np.uint32)
                crc = crc32_runs(data, starts, ends, begun[rows])
                cut = crc % one_in == 0
                raw, counts = data.tobytes(), {}
                for s, e, c, k in zip(starts[cut].tolist(), ends[cut].tolist(), crc[cut].tolist(), letters[cut].tolist()):
                    if k > min_letters:
                        w = raw[s:e].decode()
                        w = w[:c % k] + w[c % k + 1:]
                        counts[w] = counts.get(w, 0) + 1
                whole = np.flatnonzero(~cut)
                _, first, n = np.unique(h[whole], return_index=True, return_counts=True)
                first = whole[first]
                words = [raw[s:e].decode() for s, e in zip(starts[first].tolist(), ends[first].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(words + list(counts), pa.string()),
                                                  pa.array(n.tolist() + list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    return (rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def numbered(words: DataFrame) -> DataFrame:
    """(word, n, r): r counts from 0 by n descending, then word.  The words are
    sorted by range into a written table; a number is the count of rows in
    the parts before (one row a part, broadcast) plus the place in the part."""
    order = [F.col("n").desc(), F.col("word").asc()]
    rows = kept(words.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("at", F.monotonically_increasing_id()))
    rows = rows.select("word", "n", F.shiftright("at", 33).alias("part"),
                       F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
              .select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")))
    return rows.join(F.broadcast(starts), "part").select("word", "n", (F.col("start") + F.col("at")).alias("r"))


def node_pairs(words: list[str], r: np.ndarray):
    """The dictionary rows (p, s, kind, r) of some words: kind 2 for cuts, 1 for
    skips of the last letter of a run of equal letters, 0 for other skips."""
    size = np.array([len(w) for w in words])
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum(size)
    starts = ends - size
    owner = np.repeat(np.arange(len(words)), size)
    up, down = _powers(len(code) + 1)
    value = mix64(code + np.uint64(1))
    fore = np.concatenate([[np.uint64(0)], np.cumsum(value * up[:len(code)], dtype=np.uint64)])
    back = np.concatenate([[np.uint64(0)], np.cumsum(value * down[:len(code)], dtype=np.uint64)])
    span = lambda a, b: (b - a).astype(np.uint64) << np.uint64(40)

    def prefix(i, w):  # node of letters starts[w] .. i
        return mix64((fore[i] - fore[starts[w]]) * down[starts[w]] ^ span(starts[w], i))

    def suffix(i, w):  # node of letters i .. ends[w], read backwards
        return mix64((back[ends[w]] - back[i]) * up[ends[w] - 1] ^ span(i, ends[w]))

    i = np.arange(len(code))
    last = np.ones(len(code), bool)
    last[:-1] = (code[:-1] != code[1:]) | (owner[:-1] != owner[1:])
    gap = np.concatenate([i, ends])
    at = np.concatenate([owner, np.arange(len(words))])
    return (np.concatenate([prefix(i, owner), prefix(gap, at)]).view(np.int64),
            np.concatenate([suffix(i + 1, owner), suffix(gap, at)]).view(np.int64),
            np.concatenate([last.astype(np.int32), np.full(len(gap), 2, np.int32)]), np.concatenate([r[owner], r[at]]))


def neighbours(words: DataFrame) -> DataFrame:
    """(r, n_near, best) of the numbered words that have a near word: how many,
    and the least number among them."""
    def run(batches):
        for b in batches:
            text, r = b["word"].to_pylist(), b["r"].to_numpy()
            done = 0
            while done < len(text):
                to, letters = done, 0
                while to < len(text) and (to == done or letters + len(text[to]) < _VALUES // 2):
                    letters += len(text[to])
                    to += 1
                p, s, kind, own = node_pairs(text[done:to], r[done:to])
                for i in range(0, len(p), _VALUES):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i:i + _VALUES]) for c in (p, s, kind, own)], ["p", "s", "kind", "r"])
                done = to

    group = (words.select("word", "r").where("word <> ''").mapInArrow(run, _PAIRS).groupBy("p", "s")
             .agg(F.collect_list(F.struct("kind", "r")).alias("m")).where(F.size("m") > 1))
    group = group.select(
        "m", F.expr("array_sort(transform(filter(m, x -> x.kind < 2), x -> x.r))").alias("skip"),
        F.expr("array_sort(transform(filter(m, x -> x.kind = 1), x -> x.r))").alias("last"),
        F.expr("array_min(transform(filter(m, x -> x.kind = 2), x -> x.r))").alias("short"))
    own = group.select(F.expr("""inline(transform(m, x -> if(x.kind = 2,
        struct(x.r as r, cast(size(last) as long) as n_near, if(size(last) > 0, last[0], null) as best),
        struct(x.r as r, cast(size(skip) - 1 + if(x.kind = 1 and short is not null, 1, 0) as long) as n_near,
               least(if(size(skip) > 1, if(skip[0] = x.r, skip[1], skip[0]), null),
                     if(x.kind = 1, short, null)) as best))))"""))
    return own.where("n_near > 0").groupBy("r").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(r, root): from each word of `links` (r, form_r), follow forms to the last.

    Every round doubles the steps taken and is written.  Frequencies grow by
    the ratio with each form, so chains are short (18 steps at most for counts
    that fit a long, hence 5 rounds and one to see that nothing changes).
    """
    links = kept(links.select("r", F.col("form_r").alias("root")))
    while True:
        on = links.select(F.col("r").alias("root"), F.col("root").alias("next"))
        moved = kept(links.join(on, "root", "left")
                     .select("r", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if moved.where("moved").limit(1).count() == 0:
            return links
        links = moved.select("r", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n over a table of distinct words with
    counts (word, n).

    form: the near word (one letter inserted, deleted or replaced) of the largest n, ties
    by the least word, if its n >= ratio * n, else null.  root: the last form
    reached from word, word itself if it has none.  Words are code point strings;
    empty words have no neighbours.  An empty table gives no rows.
    """
    words = numbered(words)
    form = words.select(F.col("r").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = words.join(neighbours(words), "r", "left").join(form, "best", "left")
    valid = F.col("form_n") >= F.lit(ratio) * F.col("n")
    found = kept(found.select("r", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                              *[F.when(valid, F.col(c)).alias(c) for c in ("form", "form_n")],
                              F.when(valid, F.col("best")).alias("form_r")))
    last = roots(found.where("form_r is not null"))
    name = words.select(F.col("r").alias("root_r"), F.col("word").alias("root"))
    named = last.withColumnRenamed("root", "root_r").join(name, "root_r").select("r", "root")
    return (found.join(named, "r", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """`variants` of the words of whole `documents` texts."""
    return variants(word_counts(docs))
