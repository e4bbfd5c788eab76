"""Operator 10, toxicity: a weighted lexicon matched by Aho-Corasick.

Text is folded first: lower case, accents and width forms removed, homoglyphs
and digit substitutions replaced, everything else a blank.  Lexicon terms are
whole words or word beginnings; one automaton finds all terms and exception
phrases in one pass.  A term inside an exception phrase doesn't count.  The sum
of the weights of the matches, normalised by the number of words, goes through
a logistic curve.  Terms, weights, exceptions and the curve are learned from a
bounded labelled sample: the counting is a Spark aggregation, and only terms
that are far more frequent in one label than chance allows reach the driver.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from calltrail.llm.base import crc_mod, kept, labelled_sample

#: Labelled documents to learn from, at most.
MAX_ROWS = 8_000
#: Lengths of the word beginnings that may become terms.
STEMS = range(4, 9)

# Characters that stand for a Latin letter.
HOMOGLYPHS = {
    "0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe",
}
#: After the above, i counts as l, since 1 and | stand for either.
SAME = {"i": "l"}


class Fold(dict):
    """Code point -> folded text, filled as characters are met."""

    def __missing__(self, code):
        c = chr(code).lower()
        out = ""
        for x in c if c in HOMOGLYPHS else unicodedata.normalize("NFKD", c):
            x = HOMOGLYPHS.get(x, x)
            if unicodedata.category(x[0]) not in ("Mn", "Me", "Cf"):  # marks and invisible characters vanish
                out += "".join(SAME.get(y, y) if y.isalnum() else " " for y in x.lower())
        self[code] = out
        return out


def fold(text: str, table: Fold) -> str:
    """The folded words, each with one blank before it, and one at the end."""
    return " " + " ".join(text.translate(table).split()) + " "


@dataclass
class Lexicon:
    """terms: " stem" or " word " -> weight; exceptions: phrases " a b "; the
    curve is 1 / (1 + exp(-(bias + slope * log(1 + 100 * density))))."""
    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -2.0
    slope: float = 1.0

    def automaton(self):
        import ahocorasick
        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w))
        for p in self.exceptions:
            a.add_word(p, (len(p), None))
        a.make_automaton()
        return a


def matches(folded: str, automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the terms that count: at one start the longest,
    none that overlaps an exception phrase."""
    found, spared = {}, []
    for end, (size, weight) in automaton.iter(folded) if len(automaton) else ():
        start = end + 1 - size
        if weight is None:
            spared.append((start, end))
        elif size > found.get(start, (0, 0))[0]:
            found[start] = (size, weight)
    spared.sort()
    starts = [a for a, _ in spared]
    ends = list(accumulate((b for _, b in spared), max))  # how far the phrases up to one reach
    out = []
    for s, (n, w) in sorted(found.items()):
        i = bisect_right(starts, s)
        if not i or ends[i - 1] <= s:
            out.append((s, s + n, w))
    return out


def _density(text: str, table: Fold, automaton) -> float:
    folded = fold(text, table)
    return sum(w for _, _, w in matches(folded, automaton)) / (folded.count(" ") + 9)


def _counted(sample: DataFrame, words) -> DataFrame:
    """Documents of each label that hold a phrase; words: text -> its phrases."""
    def run(batches):
        for b in batches:
            parts = [(w, y) for t, y in zip(b["text"], b["y"]) for w in set(words(t))]
            yield pd.DataFrame(parts, columns=["phrase", "y"])

    return (sample.mapInPandas(run, "phrase string, y int").groupBy("phrase")
            .agg(F.sum("y").alias("d1"), F.sum(1 - F.col("y")).alias("d0")))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from at most `max_rows` labelled documents; those with
    crc32(doc_id) mod 4 = 2 are never learned from.  `exceptions` are phrases
    to spare besides the learned ones.

    A term needs a Poisson tail (as its log-likelihood ratio) beyond the log of
    the number of candidates, so chance finds are not expected; its weight is
    its smoothed log odds.  An exception is a pair of neighbouring words of
    which one matches, met in three documents or more of label 0 and relatively
    more often there.
    """
    sample = kept(labelled_sample(docs, labels, "toxic", 4, 2, max_rows))
    n1, n0 = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*") - F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n1 or not n0:
        return Lexicon(bias=math.log((n1 + 1) / (n0 + 1)) if n1 + n0 else -2.0)

    def stems(text):
        for w in set(fold(text, table).split()):
            if len(w) >= 3:
                yield f" {w} "
            for n in STEMS:
                if len(w) >= n:
                    yield " " + w[:n]

    table = Fold()
    rate = n1 / (n1 + n0)
    odds = F.log((F.col("d1") + 0.5) / (n1 + 1)) - F.log((F.col("d0") + 0.5) / (n0 + 1))
    expected = (F.col("d1") + F.col("d0")) * rate
    surplus = F.col("d1") * F.log(F.col("d1") / expected) - (F.col("d1") - expected)
    counted = kept(_counted(sample, stems).where("d1 >= 3"))
    least = math.log(max(counted.count(), 1)) + 1
    rows = counted.where((surplus >= least) & (odds >= 3)).select("phrase", odds.alias("w")).collect()
    terms: dict[str, float] = {}
    for t, w in sorted(((r["phrase"], r["w"]) for r in rows), key=lambda r: (len(r[0].strip()), r[0])):
        if not any(t[:n] in terms for n in range(2, len(t))):  # a shorter beginning says it already
            terms[t] = w
    lexicon = Lexicon(terms)

    found: list = []  # the automaton, built once in each worker

    def pairs(text):
        folded = fold(text, table)
        if not found:
            found.append(lexicon.automaton())
        for s, _, _ in matches(folded, found[0]):
            before, end = folded.rfind(" ", 0, s), folded.find(" ", s + 1)
            if s > 0:
                yield folded[before:end + 1]
            if end + 1 < len(folded):
                yield folded[s:folded.find(" ", end + 1) + 1]

    spared = _counted(sample, pairs).where("d0 >= 3").where(odds < 0).select("phrase").collect()
    lexicon.exceptions = sorted({r["phrase"] for r in spared}
                                | {fold(p, table) for p in exceptions})

    def run(batches):
        a = lexicon.automaton()
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": [_density(t, table, a) for t in b["text"]]})

    fitted = sample.mapInPandas(run, "y int, x double").toPandas().sort_values(["x", "y"])
    x, y = np.log1p(100 * fitted["x"].to_numpy()), fitted["y"].to_numpy(float)
    z = np.stack([np.ones_like(x), x], 1)
    beta = np.array([math.log(n1 / n0), 1.0])
    for _ in range(50):  # Newton steps, held back by a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        beta += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 0.05 * np.eye(2), z.T @ (y - p) - 0.05 * beta)
    lexicon.bias, lexicon.slope = float(beta[0]), float(beta[1])
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted, n_matches of every whole
    text.  Null and empty texts match nothing."""
    def run(batches):
        a, table = lexicon.automaton(), Fold()
        for b in batches:
            sums, counts = [], []
            for t in b["text"].to_pylist():
                folded = fold(t or "", table)
                found = matches(folded, a)
                sums.append(sum(w for _, _, w in found) / (folded.count(" ") + 9))
                counts.append(len(found))
            z = lexicon.bias + lexicon.slope * np.log1p(100 * np.array(sums, float))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(1 / (1 + np.exp(-z))), pa.array(counts, pa.int64())],
                                             ["doc_id", "score", "n_matches"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, score double, n_matches long")
            .select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"), "n_matches"))
