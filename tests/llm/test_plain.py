"""Operators 2, 3 and 10 against plain re-readings of their methods."""

import math
import random

import numpy as np

from calltrail.llm import quality_gbt, quality_net, toxicity


def _plain_score(net, text):
    """The network said byte by byte."""
    m, p = quality_net, net.p
    step = m.CHUNK - m.OVERLAP
    n = max(1, math.ceil(max(len(text) - m.OVERLAP, 0) / step))
    pooled = []
    for c in range(n):
        codes = [b + 1 for b in text[c * step:c * step + m.CHUNK]]
        codes += [0] * (m.CHUNK - len(codes))
        seen = [0.0] * m.CHUNK
        for i in range(m.CHUNK):
            four = (codes + [0, 0, 0])[i:i + 4] if i + 3 < m.CHUNK else None
            at = [j for j in (i - lag for lag in m.LAGS) if j >= 0]
            same = [codes[j:j + 4] == four if four else j + 3 >= m.CHUNK for j in at]
            seen[i] = float(codes[i] > 0 and any(same))
        best = [-math.inf] * m.FILTERS
        for start in range(0, m.CHUNK - m.WIDTH + 1, m.STRIDE):
            window = [x for i in range(start, start + m.WIDTH) for x in [*map(float, p["embed"][codes[i]]), seen[i]]]
            for k in range(m.FILTERS):
                best[k] = max(best[k], sum(x * float(w) for x, w in zip(window, p["conv"][:, k])))
        pooled.append([max(b + float(s), 0.0) for b, s in zip(best, p["shift"])])
    unit = [sum(col) / n for col in zip(*pooled)] + [max(col) for col in zip(*pooled)]
    z = sum(a * float(b) for a, b in zip(unit, p["out"])) + float(p["bias"][0])
    return 1 / (1 + math.exp(-z))


def test_the_network_equals_a_plain_convolution():
    r = random.Random(1)
    texts = [b"", b"a", b"one two one two one two " * 9, "é☃ mixed ".encode() * 31, bytes(r.randrange(256) for _ in range(700)),
             b"the end of a chunk " * 13 + b"then then then"]
    net = quality_net.Net()
    net.p["shift"][:] = np.linspace(-0.5, 0.5, quality_net.FILTERS)
    net.p["bias"][:] = 0.2
    off = np.cumsum([0] + [len(t) for t in texts])
    got = net.score(*quality_net.all_chunks(off, np.frombuffer(b"".join(texts), np.uint8)))
    for t, s in zip(texts, got):
        assert abs(s - _plain_score(net, t)) < 1e-5, t


def test_flat_node_arrays_equal_a_walk_of_each_tree():
    r = np.random.default_rng(5)
    x = r.random((600, 4)).round(2)
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.7) ^ (r.random(600) < 0.1)).astype(float)
    model = quality_gbt.fit(x, y, trees=12, monotone={0: 1})
    tests = np.concatenate([x[:100], [[0, 0, 0, 0], [1, 1, 1, 1], [np.inf] * 4]])
    for row, s in zip(tests, model.score(tests)):
        z = model.bias
        for node in model.roots:
            while model.feature[node] >= 0:
                node = model.left[node] + int(row[model.feature[node]] > model.cut[node])
            z += model.value[node]
        assert abs(s - 1 / (1 + math.exp(-z))) < 1e-12
    assert len(model.roots) == 12 and {-1, 0, 1} <= set(model.feature.tolist())


def test_matches_equal_a_naive_search():
    r = random.Random(9)
    terms = {" ab": 1.0, " abc": 2.0, " abc ": 2.5, " b ": 3.0, " a": 0.5}
    phrases = [" b ca ", " abc a ", " c c "]
    automaton = toxicity.Lexicon(terms, phrases).automaton()
    some = 0
    for _ in range(400):
        words = ["".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 14))]
        t = " " + " ".join(words) + " " if words else " "
        # a phrase's last blank belongs to the next word
        spared = [(i, i + len(p) - 1) for p in phrases for i in range(len(t)) if t.startswith(p, i)]
        want = []
        for i in range(len(t)):
            here = [w for w in terms if t.startswith(w, i)]
            if here and not any(a <= i < b for a, b in spared):
                longest = max(here, key=len)
                want.append((i, i + len(longest), terms[longest]))
        assert toxicity.matches(t, automaton) == want
        some += bool(spared)
    assert some > 20
