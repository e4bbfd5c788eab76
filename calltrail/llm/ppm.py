"""Operator 7, LM scoring: prediction by partial matching over bytes.

The model is a trie of byte contexts of up to `order` bytes with the counts of
the bytes that followed them in the training documents.  A byte is coded in
the longest context seen before; if it never followed there, an escape
(method C: as likely as the number of distinct followers) leads to the next
shorter context, where the symbols of the longer one are excluded, and at last
to a uniform choice among the bytes left.  Two byte values that UTF-8 never
uses serve as padding before a text and as its end symbol.

Nothing is broadcast, and no task holds the whole trie.  Documents are packed
into blocks of about BLOCK_BYTES.  Each block lists its distinct tokens and its
distinct grams (context + byte) with their training counts; windows over a
token or gram (one row per block at most, so no hot key) give global counts;
the trie levels come from joining each gram with its suffix; and each block
gets back exactly the entries it asked for and scores its documents by table
lookup.  What crosses the network is the distinct keys of the blocks, not
the words of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from calltrail.llm.base import crc_mod, kept, text_chunks, word_table

BLOCK_BYTES = 8_000_000
ORDER = 4
PAD, END = 0xFE, 0xFF
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---- one block, in numpy ------------------------------------------------------------

def _pack(blocks: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, blocks.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(blocks)
    return sink.getvalue().to_pybytes()


def _unpack(blob) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def to_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, blob): the rows (doc_id, held, text) in compressed blocks."""
    def run(batches):
        from pyspark import TaskContext

        no, rows, size = TaskContext.get().partitionId() << 24, [], 0

        def out():
            table = pa.Table.from_batches(rows)
            return pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([_pack(table)], pa.large_binary())],
                                              ["block", "blob"]).cast(schema)

        for b in batches:
            for at, off, _ in text_chunks(b["text"], 1_000_000):
                rows.append(b.slice(at, len(off) - 1))
                size += int(off[-1])
                if size >= block_bytes:
                    yield out()
                    no, rows, size = no + 1, [], 0
        if rows:
            yield out()

    schema = pa.schema([("block", pa.int64()), ("blob", pa.binary())])
    return docs.mapInArrow(run, "block long, blob binary")


def grams(off: np.ndarray, data: np.ndarray, order: int) -> np.ndarray:
    """One number of order + 1 bytes per byte and end of each text: the byte
    (lowest) after its context."""
    n, size = len(off) - 1, np.diff(off)
    wide = size + order + 1
    first = np.concatenate([[0], np.cumsum(wide)])
    flat = np.full(int(first[-1]), PAD, np.uint8)
    row = np.repeat(np.arange(n), size)
    flat[np.arange(len(data)) + (first[:-1] - off[:-1])[row] + order] = data
    flat[first[1:] - 1] = END
    g = np.zeros(len(flat) - order if len(flat) else 0, np.uint64)
    for i in range(order + 1):
        g = (g << np.uint64(8)) | flat[i:len(g) + i]
    inside = np.ones(len(g), bool)  # windows that start in the last `order` bytes of a row run into the next
    for i in range(1, order + 1):
        inside[(first[1:-1] - i)] = False
    return g[inside]


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key over lists of (keys, counts)."""
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _rows(table: pa.Table):
    """(held, row offsets, bytes) of runs of documents of about 0.5 MB, which
    bounds the arrays of 8 bytes a character."""
    held = table["held"].to_numpy(zero_copy_only=False)
    for at, off, data in text_chunks(table["text"], 500_000):
        yield held[at:at + len(off) - 1], off, data


def block_grams(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and how often each occurs in training documents."""
    parts = []
    for held, off, data in _rows(table):
        g = grams(off, data, order)
        train = np.repeat(~held, np.diff(off) + 1)
        for rows, seen in ((train, 1), (~train, 0)):
            k, c = np.unique(g[rows], return_counts=True)
            parts.append((k, c * seen))
        if len(parts) >= 8:
            parts = [_counted(parts)]
    return _counted(parts)


def block_tokens(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Distinct tokens (A-Z lowered) and how often each occurs in training documents."""
    index: dict[bytes, int] = {}
    parts = []
    for held, off, data in _rows(table):
        data = _LOWER[data]
        rows, starts, ends, h = word_table(off, data)
        order = np.argsort(h, kind="stable")
        first = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        n = np.bincount(group, ~held[rows[order]], first.sum()).astype(np.int64)
        raw = data.tobytes()
        at = order[first]
        ids = np.empty(len(at), np.int64)
        for i, (s, e) in enumerate(zip(starts[at].tolist(), ends[at].tolist())):
            ids[i] = index.setdefault(raw[s:e], len(index))
        parts.append((ids, n))
    tokens = list(index)
    counts = np.zeros(len(tokens), np.int64)
    for ids, n in parts:
        np.add.at(counts, ids, n)
    return tokens, counts


class Table:
    """uint64 key -> float value: open addressing, filled and asked in bulk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.used, self.keys, self.values = np.zeros(1 << bits, bool), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits)
        slot = self._slot(keys)
        while len(keys):
            free = ~self.used[slot]
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            # of several keys written to one slot the last stays; value and key are written in the same order
            self.used[slot[free]] = True
            left = self.keys[slot] != keys
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def _slot(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all there."""
        slot = self._slot(keys)
        out = self.values[slot]
        left = np.flatnonzero(self.keys[slot] != keys)
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            if not self.used[slot].all():
                raise KeyError("a block asks for a key that it did not list")
            out[left] = self.values[slot]
            miss = self.keys[slot] != keys[left]
            left, slot = left[miss], slot[miss]
        return out


def score_block(table: pa.Table, tokens: pa.Table, codes: pa.Table, order: int):
    """Per document: tokens, known tokens, sum of log10(count + 1) over its
    words, log10 probability of its bytes."""
    joined = tokens["token"].combine_chunks().cast(pa.large_binary())
    words = [np.zeros(0, np.uint64)]
    for _, off, data in text_chunks(joined, 500_000):
        words.append(word_table(off, data)[3])
    counts = Table(np.concatenate(words), tokens["n"].to_numpy().astype(float))
    bits = Table(codes["gram"].to_numpy().astype(np.uint64), codes["bits"].to_numpy())
    out = []
    for _, off, data in _rows(table):
        n = len(off) - 1
        rows, _, _, h = word_table(off, _LOWER[data])
        c = counts.get(h)
        g = bits.get(grams(off, data, order))
        at = off[:-1] + np.arange(n)
        out.append(np.stack([np.bincount(rows, minlength=n) + 1, np.bincount(rows, c > 0, n),
                             np.bincount(rows, np.log10(c + 1), n), np.add.reduceat(g, at) if n else g]))
    return np.concatenate(out, 1) if out else np.zeros((4, 0))


# ---- the trie, as joins -----------------------------------------------------------------

def code_lengths(counted: DataFrame, order: int) -> DataFrame:
    """(gram, bits): log10 probability of each gram's byte after its context;
    counted: (gram, n), n = 0 for grams that occur in held-out documents only."""
    levels = {order + 1: counted.select("gram", F.col("n").alias("n"))}
    for size in range(order, 0, -1):
        levels[size] = (levels[size + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1)).alias("gram"))
                        .agg(F.sum("n").alias("n")))
    done = None
    for size in range(1, order + 2):
        now = levels[size].withColumnRenamed("n", f"n{size}")
        if done is not None:
            shorter = done.withColumnRenamed("gram", "__suffix")
            now = now.join(shorter, now["gram"].bitwiseAND(F.lit((1 << 8 * (size - 1)) - 1)) == F.col("__suffix")).drop("__suffix")
        # the followers of one context: 256 rows at most
        w = Window.partitionBy(F.shiftright("gram", 8))
        seen = F.col(f"n{size}") > 0
        now = now.withColumns({
            f"t{size}": F.sum(f"n{size}").over(w), f"d{size}": F.sum(seen.cast("long")).over(w),
            # counts that these followers have in the next shorter context
            f"x{size}": F.sum(F.when(seen, F.col(f"n{size - 1}")).otherwise(0)).over(w) if size > 1 else F.lit(0)})
        done = now

    # the escapes are nested, so name them level by level instead of repeating the expression
    out = done.select("*", cost_at(0, order).alias("c0"))
    for size in range(1, order + 2):
        out = out.select("*", cost_at(size, order).alias(f"c{size}"))
    return out.select("gram", F.col(f"c{order + 1}").alias("bits"))


def cost_at(size: int, order: int) -> Column:
    """Log10 probability of the byte from its context of size - 1 bytes on,
    given column c<size - 1> of the next shorter one; size 0 is the choice among
    the bytes that no context holds."""
    c = lambda k, s=size: F.col(f"{k}{s}")
    if size == 0:
        return -F.log10(F.greatest(F.lit(256) - F.when(c("t", 1) > 0, c("d", 1)).otherwise(F.lit(0)), F.lit(1)))
    count, kinds = c("t"), c("d")
    if size <= order:  # symbols that the longer context holds are excluded here
        longer = c("t", size + 1) > 0
        count = count - F.when(longer, c("x", size + 1)).otherwise(F.lit(0))
        kinds = kinds - F.when(longer, c("d", size + 1)).otherwise(F.lit(0))
    total = F.greatest(count + kinds, F.lit(1)).cast("double")  # 0 if nothing is left: then the escape is certain
    return (F.when(c("n") > 0, F.log10(c("n") / total))
            .when((c("t") > 0) & (kinds > 0), F.log10(kinds / total) + c("c", size - 1))
            .otherwise(c("c", size - 1)))


def _per_block(blocks: DataFrame, schema: str, fields: list, make) -> DataFrame:
    def run(batches):
        for b in batches:
            for block, blob in zip(b["block"].to_pylist(), b["blob"]):
                keys, n = make(_unpack(blob.as_buffer()))
                for i in range(0, len(n), 100_000):
                    k = pa.array(keys[i:i + 100_000], fields[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), k,
                                                      pa.array(n[i:i + 100_000].astype(np.int64))],
                                                     [c.split()[0] for c in schema.split(", ")])

    return blocks.mapInArrow(run, schema)


def score(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    Documents with crc32(doc_id) mod 7 = 2 are held out, the others are the
    training data of the trie and of the token counts.  A null text is empty;
    an empty text is its end symbol.  score is the log10 probability of the
    text's bytes and end.  order: bytes of context, 1 to 6.
    """
    if not 1 <= order <= 6:
        raise ValueError("order: 1 to 6")
    held = crc_mod("doc_id", 7) == 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    blocks = kept(to_blocks(rows.select("doc_id", held.alias("held"), "text"), block_bytes))

    asked = _per_block(blocks, "block long, token binary, n long", [pa.binary()], block_tokens)
    w = Window.partitionBy("token")
    tokens = kept(asked.select("block", "token", F.sum("n").over(w).alias("n"),
                               (F.row_number().over(w.orderBy("block")) == 1).alias("first")))
    asked = _per_block(blocks, "block long, gram long, n long", [pa.int64()],
                       lambda t: (lambda k, n: (k.astype(np.int64), n))(*block_grams(t, order)))
    w = Window.partitionBy("gram")
    found = kept(asked.select("block", "gram", F.sum("n").over(w).alias("n"),
                              (F.row_number().over(w.orderBy("block")) == 1).alias("first")))
    codes = found.select("block", "gram").join(code_lengths(found.where("first").select("gram", "n"), order), "gram")

    total, distinct = (tokens.where("first").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first())
    ends = rows.select(held.alias("held")).agg(F.count_if(~F.col("held"))).first()[0]
    total, distinct = total + ends, distinct + (ends > 0)
    base = float(np.log10(total + distinct + 1))
    end = float(np.log10(ends + 1)) - base

    def run(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids, flags, parts = [], [], []
        is_gram = answers["gram"].is_valid()
        words, bits = answers.filter(answers["token"].is_valid()), answers.filter(is_gram)
        for blob in texts["blob"]:
            t = _unpack(blob.as_buffer())
            ids.append(t["doc_id"].combine_chunks() if isinstance(t["doc_id"], pa.ChunkedArray) else t["doc_id"])
            flags += t["held"].to_pylist()
            parts.append(score_block(t, words, bits, order))
        n, known, logs, text = np.concatenate(parts, 1) if parts else np.zeros((4, 0))
        ids = pa.chunked_array(ids, pa.int64()) if ids else pa.chunked_array([], pa.int64())
        return pa.table({"doc_id": ids, "held_out": pa.array(flags, pa.bool_()), "n_tokens": n.astype(np.int64),
                         "n_known": known.astype(np.int64) + (1 if ends else 0),
                         "train_tokens": np.full(len(n), total, np.int64),
                         "base_score": logs - (n - 1) * base + end, "score": text})

    answers = (tokens.select("block", "token", F.lit(None).cast("long").alias("gram"), "n",
                             F.lit(None).cast("double").alias("bits"))
               .unionByName(codes.select("block", F.lit(None).cast("binary").alias("token"), "gram",
                                         F.lit(None).cast("long").alias("n"), "bits")))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
             "base_score double, score double")
