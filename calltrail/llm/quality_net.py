"""Operator 2, quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into overlapping chunks that cover all of it.
Each byte has a learned embedding and one input more: whether the four bytes
that start at it stood in the chunk shortly before (filters alone cannot see
that a word repeats).  Learned filters of WIDTH bytes slide over each chunk by STRIDE; their rectified
outputs are max-pooled inside the chunk.  A document is the mean and the
maximum of its chunks' pooled outputs, and one logistic unit combines them into
a probability.  Weights are learned here by Adam on a bounded labelled sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from calltrail.llm.base import crc_mod, labelled_sample, text_chunks

WIDTH, STRIDE, FILTERS, EMBED = 16, 8, 24, 4
#: Distances looked back for a repeat, in bytes.
LAGS = range(3, 35)
_IN = EMBED + 1  # inputs per byte
#: Bytes of a chunk, and bytes that it shares with the next one.
CHUNK, OVERLAP = 256, 16
#: Labelled documents to learn from, and chunks (spread evenly over the text) of each, at most.
MAX_ROWS, MAX_CHUNKS = 3_000, 12


def chunk_bytes(data: np.ndarray) -> np.ndarray:
    """The text's chunks as rows of CHUNK bytes + 1 (0 pads the last); an empty
    text is one chunk of padding."""
    step = CHUNK - OVERLAP
    n = max(1, -(-max(len(data) - OVERLAP, 0) // step))
    flat = np.zeros((n - 1) * step + CHUNK, np.int16)
    flat[:len(data)] = data
    flat[:len(data)] += 1
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::step]


def all_chunks(off: np.ndarray, data: np.ndarray):
    """Chunks of all rows, and the first chunk of each row."""
    parts = [chunk_bytes(data[off[i]:off[i + 1]]) for i in range(len(off) - 1)]
    first = np.cumsum([0] + [len(p) for p in parts])
    return np.concatenate(parts), first


def repeats(chunks: np.ndarray) -> np.ndarray:
    """1 where the four bytes from here equal the four bytes some LAGS before."""
    c = chunks.astype(np.int64)
    four = np.zeros(c.shape, np.int32)
    four[:, :-3] = (c[:, :-3] + (c[:, 1:-2] << 8) + (c[:, 2:-1] << 16) + (c[:, 3:] << 24)).astype(np.int32)
    seen = np.zeros(c.shape, bool)
    for lag in LAGS:
        seen[:, lag:] |= four[:, lag:] == four[:, :-lag]
    return (seen & (c > 0)).astype(np.float32)


class Net:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {"embed": r.normal(0, 0.5, (257, EMBED)).astype(np.float32),
                  "conv": r.normal(0, (WIDTH * _IN) ** -0.5, (WIDTH * _IN, FILTERS)).astype(np.float32),
                  "shift": np.zeros(FILTERS, np.float32),
                  "out": r.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "bias": np.zeros(1, np.float32)}

    def _positions(self, chunks):
        """Input windows: (chunks, positions, WIDTH * inputs)."""
        e = np.concatenate([self.p["embed"][chunks], repeats(chunks)[:, :, None]], 2).reshape(len(chunks), -1)
        w = np.lib.stride_tricks.sliding_window_view(e, WIDTH * _IN, axis=1)[:, ::STRIDE * _IN]
        return np.ascontiguousarray(w)

    def pooled(self, chunks: np.ndarray):
        """Max-pooled filter outputs of each chunk, with what `learn` needs."""
        w = self._positions(chunks)
        z = w.reshape(-1, WIDTH * _IN) @ self.p["conv"]
        z = z.reshape(len(chunks), -1, FILTERS)
        top = z.max(1)
        return np.maximum(top + self.p["shift"], 0), w, z

    def document(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = np.diff(first)[:, None]
        return np.concatenate([np.add.reduceat(pooled, first[:-1]) / n, np.maximum.reduceat(pooled, first[:-1])], 1)

    def score(self, chunks: np.ndarray, first: np.ndarray, block: int = 2_000) -> np.ndarray:
        pooled = np.concatenate([self.pooled(chunks[i:i + block])[0] for i in range(0, len(chunks), block)])
        z = self.document(pooled, first) @ self.p["out"] + self.p["bias"]
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def learn(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.004,
              least_steps: int = 700):
        """Adam on the logistic loss, for `epochs` and at least `least_steps`;
        both labels weigh the same in the first half of the epochs, rows as
        they are in the second."""
        r, t = np.random.default_rng(5), 0
        epochs = max(epochs, -(-least_steps * batch // len(y)))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at:at + batch]
                chunks = np.concatenate([texts[i] for i in rows])
                first = np.cumsum([0] + [len(texts[i]) for i in rows])
                g = self._gradient(chunks, first, y[rows], 2 * epoch < epochs, y.mean())
                t += 1
                step = rate * (0.3 if 3 * epoch >= 2 * epochs else 1)
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v2[k] += 0.001 * (g[k] ** 2 - v2[k])
                    self.p[k] -= step * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v2[k] / (1 - 0.999 ** t)) + 1e-7)
        return self

    def _gradient(self, chunks, first, y, even, share):
        pooled, w, z = self.pooled(chunks)
        doc, n = self.document(pooled, first), np.diff(first)
        s = 1 / (1 + np.exp(-(doc @ self.p["out"] + self.p["bias"])))
        dz = (s - y).astype(np.float32)
        if even:
            dz *= np.where(y > 0, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(np.float32)
        dz /= len(y)
        g = {"out": doc.T @ dz, "bias": dz.sum(keepdims=True)}
        row = np.repeat(np.arange(len(y)), n)
        d_mean, d_max = np.outer(dz, self.p["out"][:FILTERS]), np.outer(dz, self.p["out"][FILTERS:])
        d = (d_mean / n[:, None])[row]
        d += d_max[row] * (pooled == doc[:, FILTERS:][row])
        d *= pooled > 0
        best = z.argmax(1)  # chunk, filter -> position
        dz_all = np.zeros_like(z)
        np.put_along_axis(dz_all, best[:, None, :], d[:, None, :].astype(np.float32), 1)
        flat = dz_all.reshape(-1, FILTERS)
        g["shift"] = d.sum(0).astype(np.float32)
        g["conv"] = w.reshape(-1, WIDTH * _IN).T @ flat
        dw = (flat @ self.p["conv"].T).reshape(len(chunks), -1, WIDTH, _IN)
        de = np.zeros((257, EMBED), np.float32)
        for i in range(WIDTH):
            codes = chunks[:, i:i + STRIDE * dw.shape[1]:STRIDE].ravel()
            for j in range(EMBED):
                de[:, j] += np.bincount(codes, dw[:, :, i, j].ravel(), 257)
        g["embed"] = de
        return g


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chunks: int = MAX_CHUNKS) -> Net:
    """A network fitted on at most `max_rows` labelled documents (crc32(doc_id)
    mod 5 = 0 is never learned from), of each at most `max_chunks` chunks spread
    evenly over the whole text.  Without labelled rows the weights stay at their
    start."""
    def run(batches):
        for b in batches:
            for at, off, data in text_chunks(b["text"]):
                picked = []
                for i in range(len(off) - 1):
                    c = chunk_bytes(data[off[i]:off[i + 1]])
                    c = c[np.unique(np.linspace(0, len(c) - 1, max_chunks).round().astype(int))]
                    picked.append(c.astype("<i2").tobytes())
                part = b.slice(at, len(off) - 1)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["y"], pa.array(picked, pa.binary())],
                                                 ["doc_id", "y", "chunks"])

    rows = (labelled_sample(docs, labels, "quality", 5, 0, max_rows)
            .select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text")
            .mapInArrow(run, "doc_id long, y int, chunks binary").collect())
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["chunks"])))
    net = Net()
    if rows:
        net.learn([np.frombuffer(r["chunks"], "<i2").reshape(-1, CHUNK) for r in rows],
                  np.array([r["y"] for r in rows], np.float32))
    return net


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null and empty texts get
    the score of a chunk of padding."""
    def run(batches):
        for b in batches:
            for at, off, data in text_chunks(b["text"], 400_000):
                s = net.score(*all_chunks(off, data))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(at, len(s)), pa.array(s, pa.float64())],
                                                 ["doc_id", "score"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, score double"))


def classify(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold)."""
    return score(docs, net).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
                                   (F.col("score") >= threshold).cast("int").alias("predicted"))
