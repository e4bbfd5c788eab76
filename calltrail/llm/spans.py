"""Operator 6, substring dedup: sliding sentence spans.

Sentences end at . ! ? (and the ideographic full stop) before a blank, and at
line breaks.  From every sentence on, runs of sentences with enough words are
hashed over their words; a run ends at the latest where any sentences, however
short, have enough.  A run that stands in several documents
belongs to the one with the least doc_id; in all others, and wherever it
repeats inside one document, the sentences that it covers are removed.

Two shuffles of (hash, doc_id) rows find the repeated runs: a pre-aggregated
minimum per hash, and a join back.  A run that a third of all documents hold
is one row of the aggregate, and its rows in the join are plain rows of a skewed key,
which Spark splits.  A 64-bit hash stands for a run's words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from calltrail.llm.base import kept, mix64, text_chunks, word_table

#: Sentences of a run -> words that it must have.  Ten sentences have ten words.
MIN_WORDS = {1: 15, 2: 15, **dict.fromkeys(range(3, 11), 10)}


def sentences(off: np.ndarray, data: np.ndarray):
    """(row, first byte, words, hash) of each sentence.  A sentence's bytes
    reach to the next sentence of the row, or to the row's end."""
    rows, starts, ends, h = word_table(off, data)
    if not len(rows):
        return rows, starts, starts, h
    last = data[ends - 1]
    stop = (last == ord(".")) | (last == ord("!")) | (last == ord("?"))
    wide = np.flatnonzero((last == 0x82) & (ends - starts >= 3))
    stop[wide] = (data[ends[wide] - 2] == 0x80) & (data[ends[wide] - 3] == 0xE3)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    stop[:-1] |= (lines[starts[1:]] > lines[ends[:-1]]) | (rows[1:] != rows[:-1])
    first = np.concatenate([[0], np.flatnonzero(stop[:-1]) + 1])
    n = np.diff(np.append(first, len(rows)))
    place = (np.arange(len(rows)) - np.repeat(first, n) + 1).astype(np.uint64)
    word = mix64(h + place * np.uint64(0xD1342543DE82EF95))
    return rows[first], starts[first], n, mix64(np.add.reduceat(word, first))


def runs(rows: np.ndarray, n: np.ndarray, h: np.ndarray, min_words: dict[int, int]):
    """(first sentence, sentences, hash) of the runs inside one row.  A run is
    left out if it is one without its first and without its last sentence too:
    these two cover it, and they are repeated wherever it is."""
    at, size, out = [], [], []
    g, words = np.zeros(len(h), np.uint64), np.zeros(len(h), np.int64)
    shorter = np.zeros(len(h) + 1, bool)
    for k in range(1, max(min_words) + 1):
        m = len(h) - k + 1
        if m <= 0:
            break
        g = mix64(g[:m] * np.uint64(0x2545F4914F6CDD1D) + h[k - 1:])
        words = words[:m] + n[k - 1:]
        enough = np.zeros(m, bool)
        if k in min_words:
            enough = (rows[:m] == rows[k - 1:]) & (words >= min_words[k])
            i = np.flatnonzero(enough & ~(shorter[:m] & shorter[1:m + 1]))
            at.append(i), size.append(np.full(len(i), k)), out.append(mix64(g[i] + np.uint64(k)))
        shorter = enough
    if not at:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    return np.concatenate(at), np.concatenate(size), np.concatenate(out)


def _first_in_row(rows: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of each run, whether its row holds it for the first time there."""
    order = np.lexsort((at, h, rows[at]))
    new = np.ones(len(at), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (rows[at][order][1:] != rows[at][order][:-1])
    out = np.empty(len(at), bool)
    out[order] = new
    return out


def _keyed(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs under safe names with `__anon`, `__key`: its id, or a number of its own
    for a row without an id (these come after all others).  Such rows are
    written out once, so that the number is one and the same in every pass."""
    key = F.col("`doc_id`").cast("long")
    plain = docs.withColumns({"__key": key, "__anon": F.lit(False)}).where("__key is not null")
    no_id = kept(docs.where(key.isNull()).toDF(*names).withColumn("__key", F.monotonically_increasing_id()))
    return plain.toDF(*names, "__key", "__anon").unionByName(no_id.withColumn("__anon", F.lit(True)))


def repeated(keyed: DataFrame, text: str, min_words: dict[int, int] = MIN_WORDS) -> DataFrame:
    """(__anon, __key, hashes): for each document that is not the first with some run,
    those runs' hashes; keyed: `__anon`, `__key` and the column `text`."""
    def run(batches):
        for b in batches:
            for at, off, data in text_chunks(b[text]):
                rows, _, n, h = sentences(off, data)
                first, _, g = runs(rows, n, h, min_words)
                own = _first_in_row(rows, first, g)
                doc = pa.array(rows[first[own]] + at)
                yield pa.RecordBatch.from_arrays([pa.array(g[own].view(np.int64)), b["__key"].take(doc), b["__anon"].take(doc)],
                                                 ["h", "__key", "__anon"])

    found = keyed.select("__key", "__anon", text).mapInArrow(run, "h long, __key long, __anon boolean")
    doc = F.struct("__anon", "__key")
    owner = found.groupBy("h").agg(F.min(doc).alias("owner"), F.max(doc).alias("other")).where("owner <> other")
    return (found.join(owner.select("h", "owner"), "h").where(doc != F.col("owner"))
            .groupBy("__anon", "__key").agg(F.collect_list("h").alias("hashes")))


def remove_repeats(docs: DataFrame, min_words: dict[int, int] = MIN_WORDS) -> DataFrame:
    """docs with all its columns, the repeated sentences cut out of `text`, and
    `__sentences`, `__removed` (counts).

    Every row stays, with an empty text if all its sentences go; a null text
    stays null.  Rows that repeat a doc_id count as one document, so they are
    cut alike.  Rows without an id are a document each, after all with one.
    """
    fields = docs.schema.fields
    names = [f"c{i}" for i in range(len(fields))]  # safe names: a table may hold clashing ones
    text = names[[f.name for f in fields].index("text")]
    keyed = _keyed(docs, names)
    joined = keyed.join(repeated(keyed, text, min_words), ["__anon", "__key"], "left").select(*names, "hashes")

    def run(batches):
        for b in batches:
            for at, off, data in text_chunks(b[text]):
                part = b.slice(at, len(off) - 1)
                cleaned, total, gone = cut(off, data, part["hashes"])
                valid = part[text].is_valid()
                out = pa.array(cleaned, pa.binary()).cast(pa.string())
                out = pa.compute.if_else(valid, out, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [out if c == text else part[c] for c in names] + [pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                    [*names, "__sentences", "__removed"])

    def cut(off, data, lists):
        rows, start, n, h = sentences(off, data)
        first, size, g = runs(rows, n, h, min_words)
        gone = ~_first_in_row(rows, first, g)
        flat = lists.flatten().to_numpy().view(np.uint64)
        if len(flat):
            count = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
            owner = np.repeat(np.arange(len(count)), count).astype(np.uint64)
            pair = lambda r, x: mix64(x + r * np.uint64(0xC2B2AE3D27D4EB4F))
            gone |= np.isin(pair(rows[first].astype(np.uint64), g), pair(owner, flat))
        covered = np.zeros(len(rows) + 1, np.int64)
        np.add.at(covered, first[gone], 1)
        np.add.at(covered, first[gone] + size[gone], -1)
        covered = np.cumsum(covered[:-1]) > 0
        m = len(off) - 1
        total, removed = np.bincount(rows, minlength=m), np.bincount(rows[covered], minlength=m)
        raw, out = data.tobytes(), []
        where = np.searchsorted(rows, np.arange(m + 1))
        for i in range(m):
            if not removed[i]:
                out.append(raw[off[i]:off[i + 1]])
                continue
            s = slice(where[i], where[i + 1])
            ends = np.append(start[s][1:], off[i + 1])
            parts = [raw[a:e] for a, e, c in zip(start[s], ends, covered[s]) if not c]
            out.append(raw[off[i]:start[s][0]] * bool(parts) + b"".join(parts))
        return out, total, removed

    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(names, fields))
    done = joined.mapInArrow(run, schema + ", __sentences long, __removed long")
    return done.toDF(*[f.name for f in fields], "__sentences", "__removed")


def deduplicated(docs: DataFrame, min_words: dict[int, int] = MIN_WORDS) -> DataFrame:
    """doc_id, n_sentences, n_removed and the text that is left, one row per row."""
    return (remove_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_words)
            .select("doc_id", F.col("__sentences").alias("n_sentences"), F.col("__removed").alias("n_removed"), "text"))
