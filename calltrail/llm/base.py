"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from calltrail.session import checkpoint_dir


def crc_mod(col: str, mod: int) -> Column:
    """crc32(col as text) mod `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % mod


def kept(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back: lineage is
    cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int,
                    max_rows: int, seed: int = 7) -> DataFrame:
    """At most `max_rows` labelled documents (doc_id, text, y) to learn from.

    Rows with crc32(doc_id) mod `mod` = `held`, with a null label or without a
    document are left out.  The sample is the rows with the smallest hash of
    the id, so it is the same on every run; being at most `max_rows` (id,
    label) pairs, it is safe to broadcast.  An id labelled twice counts once,
    with its larger label.
    """
    ids = (labels.select("doc_id", F.col(label).cast("int").alias("y"))
           .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", mod) != held))
           .groupBy("doc_id").agg(F.max("y").alias("y"))
           .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows))
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")


# ---- text as bytes: vectorised over the Arrow buffers of a batch -----------------------

def text_chunks(column, max_bytes: int = 2_000_000):
    """Cut an Arrow string column into runs of whole rows of about `max_bytes`;
    yields (first row, row offsets from 0, bytes).  A null row has no bytes."""
    import pyarrow as pa

    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    col = col.cast(pa.large_binary()) if col.type != pa.large_binary() else col
    if col.null_count:
        col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at, n = 0, len(col)
    while at < n:
        to = int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, off[at:to + 1] - off[at], data[off[at]:off[to]]
        at = to


def lower_az(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z, and nothing else, in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse mod 2^64
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the shift-multiply steps of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_table(off: np.ndarray, data: np.ndarray, word: np.ndarray | None = None):
    """Words `[^\\x20\\x09-\\x0D]+` of the rows, or the runs of the bytes that
    `word` marks: (row of each word, first byte, end byte, 64-bit hash), in text order."""
    word = ~_SPACE[data] if word is None else word
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = off[(off > 0) & (off < len(data))]  # rows are adjacent: a word never crosses into the next
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return rows, starts, ends, mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def windows(rows: np.ndarray, h: np.ndarray, n: int):
    """Hashes of the runs of `n` adjacent words inside one row: (index of the
    first word, hash)."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(h) - n + 1
    g = np.zeros(m, np.uint64)
    for i in range(n):
        g = mix64(g * np.uint64(0x2545F4914F6CDD1D) + h[i:i + m])
    at = np.flatnonzero(rows[:m] == rows[n - 1:])
    return at, g[at]
