"""Operator 3, quality rules: boosted trees over document statistics.

Statistics of every whole text come from one vectorised pass over the bytes of
an Arrow batch (no shuffle).  The trees are fitted here in numpy, on the
statistics of a bounded labelled sample, by gradient boosting of the logistic
loss on histograms; features named in MONOTONE may only move the score in the
stated direction.  All trees lie in five flat node arrays, and a batch is
scored by stepping all its rows down one level at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from calltrail.llm.base import labelled_sample, text_chunks, windows, word_table

SYMBOLS = "#*$%&|<>"
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
            "digit_share", "punctuation_share", "words_per_line", "high_share", "distinct_share"]
#: -1: a larger value never raises the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}
#: Rows with labels that a model is fitted on, at most.
MAX_ROWS = 20_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# byte classes for one bincount per batch
_KIND = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b" \t\n\r\x0b\x0c", SYMBOLS.encode(), bytes(range(65, 91)), bytes(range(48, 58)),
                             b"!\"'(),-./:;=?@[]^_`{}~\\+"), 1):
    _KIND[list(_chars)] = _i
_KIND[0x80:0xC0] = 6  # continuation bytes: not the start of a code point
_KIND[0xC0:] = 7


def statistics(off: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and shares of each row's text; words are `[^\\x20\\x09-\\x0D]+`."""
    n = len(off) - 1
    size = np.diff(off)
    row_of = np.repeat(np.arange(n), size)
    kinds = np.bincount(row_of * 8 + _KIND[data], minlength=8 * n).reshape(n, 8)
    rows, _, _, h = word_table(off, data)
    words = np.bincount(rows, minlength=n)

    # words inside 3-word windows found twice or more in the row
    at, g = windows(rows, h, 3)
    repeat = np.zeros(n, np.int64)
    if len(at):
        order = np.lexsort((g, rows[at]))
        same = (g[order][1:] == g[order][:-1]) & (rows[at][order][1:] == rows[at][order][:-1])
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        covered = np.zeros(len(h), bool)
        for i in range(3):
            covered[hit + i] = True
        repeat = np.bincount(rows[covered], minlength=n)

    pair = np.lexsort((h, rows))
    new = np.ones(len(h), bool)
    new[1:] = (h[pair][1:] != h[pair][:-1]) | (rows[pair][1:] != rows[pair][:-1])
    distinct = np.bincount(rows[pair][new], minlength=n)

    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        found = [x for x in data[off[i]:off[i + 1]].tobytes().split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        lines[i], dup[i] = len(found), len(found) - len(set(found))

    share = lambda a, b: a / np.maximum(b, 1)
    chars = size - kinds[:, 6] - kinds[:, 1]
    return {
        "n_words": words, "word_chars": chars, "n_symbols": kinds[:, 2], "n_dup_lines": dup, "n_repeat_words": repeat,
        "log_words": np.log1p(words), "word_length": share(chars, words), "symbol_share": share(kinds[:, 2], chars),
        "dup_line_share": share(dup, lines), "repeat_share": share(repeat, words),
        "upper_share": share(kinds[:, 3], chars), "digit_share": share(kinds[:, 4], chars),
        "punctuation_share": share(kinds[:, 5], chars), "words_per_line": np.log1p(share(words, lines)),
        "high_share": share(kinds[:, 7], chars), "distinct_share": share(distinct, words),
    }


class Trees:
    """Binary trees of one depth in flat node arrays; node i of a tree has the
    children `left[i]` and `left[i] + 1`, a leaf points to itself."""

    def __init__(self, bias: float, depth: int):
        self.bias, self.depth, self.roots = bias, depth, []
        self.feature, self.cut, self.left, self.value = [], [], [], []

    def add(self, feature=-1, cut=np.inf, value=0.0) -> int:
        self.feature.append(feature), self.cut.append(cut), self.value.append(value)
        self.left.append(len(self.left))
        return len(self.left) - 1

    def freeze(self) -> "Trees":
        self.feature, self.left = np.array(self.feature, np.int32), np.array(self.left, np.int32)
        self.cut, self.value = np.array(self.cut), np.array(self.value)
        self.leaf = self.feature < 0
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of `x` (rows, features)."""
        at = np.tile(np.array(self.roots, np.int32), (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[row, np.maximum(self.feature[at], 0)] > self.cut[at]
            at = np.where(self.leaf[at], at, self.left[at] + right)
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48,
        l2: float = 1.0, least: float = 2.0, monotone: dict[int, int] | None = None) -> Trees:
    """Gradient boosting of the logistic loss with histogram splits.

    monotone: feature index -> +1 or -1.  A split on such a feature is taken
    only if its leaf values are in that order, and the subtrees are held on
    their side of the middle, so the whole tree is monotone in it.
    """
    monotone = monotone or {}
    rate_of_ones = (y.sum() + 1) / (len(y) + 2)
    model = Trees(float(np.log(rate_of_ones / (1 - rate_of_ones))), depth)
    if not len(y):
        return model.freeze()
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    f = np.full(len(y), model.bias)

    def value(g, h, lo, hi):
        return np.clip(g / (h + l2), lo, hi)

    def gain(g, h, w):
        return g * w - 0.5 * (h + l2) * w * w

    def grow(node, rows, level, lo, hi):
        g, h = grad[rows], hess[rows]
        w = value(g.sum(), h.sum(), lo, hi)
        model.value[node] = rate * w
        best = (1e-6 + gain(g.sum(), h.sum(), w), None)
        if level < depth:
            for j, c in enumerate(cuts):
                gl = np.cumsum(np.bincount(code[rows, j], g, len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(code[rows, j], h, len(c) + 1))[:-1]
                gr, hr = g.sum() - gl, h.sum() - hl
                wl, wr = value(gl, hl, lo, hi), value(gr, hr, lo, hi)
                got = gain(gl, hl, wl) + gain(gr, hr, wr)
                bad = (hl < least) | (hr < least) | (monotone.get(j, 0) * (wr - wl) < 0)
                got[bad] = -np.inf
                if len(got) and got.max() > best[0]:
                    k = int(got.argmax())
                    best = (got[k], (j, k, wl[k], wr[k]))
        if best[1] is None:
            fitted[rows] = model.value[node]
            return
        j, k, wl, wr = best[1]
        left = model.add()
        model.add()
        model.feature[node], model.cut[node], model.left[node] = j, cuts[j][k], left
        to_right = code[rows, j] > k
        mid, way = (wl + wr) / 2, monotone.get(j, 0)
        grow(left, rows[~to_right], level + 1, mid if way < 0 else lo, mid if way > 0 else hi)
        grow(left + 1, rows[to_right], level + 1, mid if way > 0 else lo, mid if way < 0 else hi)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        grad, hess, fitted = y - p, p * (1 - p), np.zeros(len(y))
        root = model.add()
        model.roots.append(root)
        grow(root, np.arange(len(y)), 0, -np.inf, np.inf)
        f += fitted
    return model.freeze()


def document_statistics(docs: DataFrame, columns: list[str], model: Trees | None = None) -> DataFrame:
    """`columns` (doc_id, y, ...) of each row with its counts and features, and
    with a model its score.  A null text has no words."""
    schema = docs.select(*columns).schema
    types = [(c, pa.int64()) for c in COUNTS] + [(c, pa.float64()) for c in FEATURES]
    types += [("score", pa.float64())] if model else []

    def run(batches):
        for b in batches:
            keep = b.select(columns)
            for at, off, data in text_chunks(b["text"]):
                s = statistics(off, data)
                if model:
                    s["score"] = model.score(np.stack([s[c] for c in FEATURES], 1))
                part = keep.slice(at, len(off) - 1)
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array(s[c].astype(t.to_pandas_dtype()), t)
                                                                 for c, t in types], columns + [c for c, _ in types])

    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
                    + [f"{c} {'long' if t == pa.int64() else 'double'}" for c, t in types])
    return docs.select(*columns, "text").mapInArrow(run, out)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Trees fitted on at most `max_rows` labelled documents (those with
    crc32(doc_id) mod 5 = 0 are never learned from).  Only their statistics
    reach the driver.  Without labelled rows the score is constant."""
    sample = labelled_sample(docs, labels, "quality", 5, 0, max_rows)
    pdf = document_statistics(sample, ["doc_id", "y"]).select("doc_id", "y", *FEATURES).toPandas()
    pdf = pdf.sort_values(["doc_id", *FEATURES])  # the same trees whatever order the rows came in
    return fit(pdf[FEATURES].to_numpy(float), pdf["y"].to_numpy(float),
               monotone={FEATURES.index(k): v for k, v in MONOTONE.items()})


def _failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def keep_good(docs: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with their columns, that `judge` keeps."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # safe names: a table may hold clashing ones
    plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    good = document_statistics(plain, names, model).where(~_failed() & (F.col("score") >= threshold))
    return good.select(*names).toDF(*docs.columns)


def judge(docs: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, score, kept.

    base_failed: under 50 words, or more than half of the words lie in 3-word
    windows that the text holds twice.  kept: not base_failed and score >=
    threshold.  Null and empty texts have no words, so they are not kept.
    """
    failed = _failed()
    return (document_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], model)
            .select("doc_id", *COUNTS, failed.alias("base_failed"), "score",
                    (~failed & (F.col("score") >= threshold)).alias("kept")))
