"""Operator 8, packing: documents into windows of `capacity` tokens.

Online sum-of-squares packing.  N[h] counts the open windows filled to level
h; a document goes to the level (or a new window) for which the sum of N[h]^2
after the move is smallest, the fuller level on a tie.  N lives in one array
of `capacity` counts, so placing a document is one vector operation.

Every input partition packs its own rows, without a shuffle: the windows of a
partition are a pure function of its rows, so a lost task is simply repeated.
A document longer than a window is first cut into full windows and a rest.
When a partition ends, the windows still open are laid end to end and cut at
every `capacity` tokens; the last one is cut into windows whose lengths are
powers of two (sequences of such lengths need no padding), so a partition of
any size pads nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Chunks kept with their ids per task, and the longest chunk worth keeping.
CACHE_CHUNKS, CACHE_CHARS = 400_000, 64


def load_encoder(path: str):
    """Byte-level BPE from a tiktoken rank file: text -> little-endian uint32 ids.

    A single blank between two non-blank characters always starts a new
    pre-token, so text is cut there and each chunk's ids are remembered;
    texts with other runs of blanks are encoded as a whole.  The added tokens
    of a JSON tokenizer beside the rank file have their own ids wherever a
    text holds their literals; such texts are encoded as a whole too.
    """
    import base64
    import json
    import os
    import re

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole, added = path.removesuffix(".tiktoken") + ".json", {}
    if os.path.exists(whole):
        with open(whole, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                            special_tokens=added)
    plain = bpe.encode_ordinary
    literal = re.compile("|".join(map(re.escape, added)) or r"(?!)").search

    class Chunks(dict):
        def __missing__(self, chunk):
            ids = np.array(plain(chunk), "<u4").tobytes()
            if len(chunk) <= CACHE_CHARS:
                if len(self) >= CACHE_CHUNKS:
                    self.clear()
                self[chunk] = ids
            return ids

    known = Chunks()
    odd = re.compile(r" \s|\s |^\s|\s$").search

    def encode(text: str) -> bytes:
        if literal(text):
            return np.array(bpe.encode(text, allowed_special="all"), "<u4").tobytes()
        if odd(text):
            return np.array(plain(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return known[first] + b"".join([known[" " + c] for c in rest]) if rest else known[first]

    return encode


class Packer:
    """Sum-of-squares packing of one stream of items."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.n = np.zeros(capacity + 1, np.int64)  # open windows by fill level
        self.open: list[list] = [[] for _ in range(capacity + 1)]

    def place(self, size: int, item) -> list | None:
        """Put an item of `size` tokens; returns the window if it is now full."""
        c, n = self.capacity, self.n
        if size == c:
            return [item]
        # change of the sum of squares for level h -> h + size; h = 0 opens a window
        gain = np.where(n[:c - size + 1] > 0, 2 * n[size:] - 2 * n[:c - size + 1] + 2, np.iinfo(np.int64).max)
        gain[0] = 2 * n[size] + 1
        if n[c - size] > 0 and size < c:
            gain[c - size] = 1 - 2 * n[c - size]  # full windows are not counted
        h = len(gain) - 1 - int(np.argmin(gain[::-1]))
        window = self.open[h].pop() if h else []
        self.n[h] -= h > 0
        window.append(item)
        if h + size == c:
            return window
        self.open[h + size].append(window)
        self.n[h + size] += 1
        return None

    def drain(self) -> list:
        """The items of all open windows, fullest window first."""
        left = [item for h in range(self.capacity, 0, -1) for w in self.open[h] for item in w]
        self.__init__(self.capacity)
        return left


def pack_partition(docs, encode, end_id: int, capacity: int):
    """Pieces (row, start, ids, doc_tokens, window no., offset) of an iterable
    of (row, text).  Every id lies in one piece."""
    packer, no = Packer(capacity), 0
    end = np.array([end_id], "<u4").tobytes()

    def close(window):
        nonlocal no
        at = 0
        for row, start, ids, total in window:
            yield row, start, ids, total, no, at
            at += len(ids) // 4
        no += 1

    for row, text in docs:
        ids = encode(text) + end
        total = len(ids) // 4
        for start in range(0, total, capacity):
            part = ids[4 * start:4 * (start + capacity)]
            full = packer.place(len(part) // 4, (row, start, part, total))
            if full:
                yield from close(full)
    left = packer.drain()
    tokens = sum(len(x[2]) // 4 for x in left)
    sizes = [capacity] * (tokens // capacity) + [1 << b for b in range(tokens.bit_length(), -1, -1)
                                                 if (tokens % capacity) >> b & 1]
    left.reverse()
    for size in sizes:
        window = []
        while size:
            row, start, ids, total = left.pop()
            take = min(size, len(ids) // 4)
            window.append((row, start, ids[:4 * take], total))
            if 4 * take < len(ids):
                left.append((row, start + take, ids[4 * take:], total))
            size -= take
        yield from close(window)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1,
                   with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start (ids of the document before it),
    length, ids_crc32 (crc32 of the ids as little-endian uint32), doc_tokens,
    sequence_id, offset, and with `with_ids` the ids themselves.

    tokenizer: path of a byte-level BPE rank file.  Each document is its ids
    and then `end_id`; a null or empty text is `end_id` alone.  Rows are packed
    one by one, so repeated rows and null ids are packed like any other.
    sequence_id is (input partition << 32) + window number.
    """
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long") + (", ids array<int>" if with_ids else "")

    def run(batches):
        from pyspark import TaskContext

        encode = load_encoder(tokenizer)
        base = TaskContext.get().partitionId() << 32
        rows = ((i, t or "") for b in batches for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()))
        out = []
        for row, start, ids, total, no, at in pack_partition(rows, encode, end_id, capacity):
            rec = (row, start, len(ids) // 4, zlib.crc32(ids), total, base + no, at)
            out.append(rec + (np.frombuffer(ids, "<u4").astype(np.int32),) if with_ids else rec)
            if len(out) >= 20_000:
                yield table(out)
                out = []
        if out:
            yield table(out)

    def table(out):
        types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                          [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
