"""Operators 11 to 13 against brute force on small tables that hold nulls, empty
and long texts, repeated rows, ties, large ids and clashing extra columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from calltrail.llm import filter_audit, spelling, suffix_match
from conftest import SMOKE

BIG = (1 << 60) + 1


def _az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _table(spark, rows, schema="doc_id long, text string, c0 string, source string, words int, n int"):
    return spark.createDataFrame([(i, t, "x", s, 1, 2) for i, t, s in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def rows():
    pdf = pd.read_parquet(f"{SMOKE}/documents.parquet").head(100)
    out = [(int(i), t, s) for i, t, s in zip(pdf.doc_id, pdf.text, pdf.source)]
    out += [(BIG, out[0][1], "a"), (BIG + 2, out[0][1], None), (None, out[1][1], ""), (None, None, "a"), (900, "", "a"),
            (901, None, None), (902, " \n\t ", "b"), (903, " ".join(t for _, t, _ in out[:40]), "b"), (904, "é" * 5000, "b"),
            (905, out[2][1], "a"), (905, out[2][1], "a"), (905, out[3][1], "a"), (906, "A B C " * 300, "c#")]
    return out


# ---- 11 benchmark decontamination -------------------------------------------------------

def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _az(text))


def _hits(rows, items, window=10):
    wins = collections.defaultdict(set)
    for item, text in items:
        w = _words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            wins[tuple(w[i:i + window])].add("" if item is None else str(item))
    out = []
    for i, text, *_ in rows:
        w, hit, found = _words(text), set(), set()
        for size in {len(k) for k in wins}:
            for a in range(len(w) - size + 1):
                k = tuple(w[a:a + size])
                if k in wins:
                    hit.update(range(a, a + size))
                    found |= wins[k]
        ids = sorted(found)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def _items(rows):
    rng = random.Random(5)
    words = _words(rows[103 - 100][1])
    items = [(k, " ".join(_words(rows[k][1])[:rng.choice([1, 2, 3, 9, 10, 11, 40])])) for k in range(0, 60, 4)]
    items += [(10, " ".join(words[3:25]).upper()), (10, " ".join(words[30:50])), (9, " ".join(words[3:25])), (None, "Zyx; the"),
              (77, None), (78, ""), (79, " - "), (80, "no such words anywhere at all in this table of texts ok"), (81, "é" * 5000)]
    return items


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_windows_of_items_against_brute_force(spark, rows, block):
    items = _items(rows)
    rows = rows + [(950 + k, f"Before {t} - after, {items[k - 1][1]}!", "z") for k, (_, t) in enumerate(items[1:], 1)]
    docs = _table(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = suffix_match.report(docs, bench, block_words=block).collect()
    assert sorted([tuple(r)[:6] for r in got], key=repr) == _hits(rows, items)
    texts = collections.defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(_words(t))
    own = collections.defaultdict(list)
    for i, t in items:
        own["" if i is None else str(i)].append(_words(t))
    longest = 0
    for r in got:  # the match is verbatim, where it is said to be, and no match at any place of the text is longer
        if not r["contaminated"]:
            assert r["longest_words"] is None
            continue
        n, a = r["longest_words"], r["longest_at"]
        ok = False
        for w in texts[r["doc_id"]]:
            best = _longest(w, [x for v in own.values() for x in v])
            ok |= best == n and any(x[k:k + n] == w[a:a + n] for x in own[r["longest_item"]] for k in range(len(x)))
        assert ok
        longest = max(longest, n)
    assert longest > 20


def _longest(w, items):
    """Words of the longest match that starts at an occurrence of a window."""
    best = 0
    for x in items:
        for k in range(max(len(x) - 10, 0) + 1 if x else 0):
            for a in range(len(w)):
                n = 0
                while k + n < len(x) and a + n < len(w) and x[k + n] == w[a + n]:
                    n += 1
                if n >= min(10, len(x) - k):
                    best = max(best, n)
    return best


def test_clean_rows_stay_with_their_columns(spark, rows):
    items = _items(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = _table(spark, rows).withColumnRenamed("n", "C0")  # c0 and C0 clash
    left = suffix_match.decontaminate(docs, bench)
    assert left.columns == docs.columns
    clean = [r[0] for r in _hits(rows, items) if not r[5]]
    assert sorted(map(repr, (r[0] for r in left.collect()))) == sorted(map(repr, clean))
    none = spark.createDataFrame([], "item_id string, text string")
    assert suffix_match.decontaminate(docs, none).count() == len(rows)
    assert suffix_match.report(docs.where("false"), bench).count() == 0


def test_suffix_array_orders_whole_suffixes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 300):
        text = rng.integers(1, 4, n).astype(np.uint64)
        want = sorted(range(n), key=lambda i: text[i:].tolist())
        assert suffix_match.suffix_array(text, n).tolist() == want


# ---- 12 filter interaction audit -----------------------------------------------------------

def _audit(rows, labels):
    first, docs = {}, []
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs.append((s or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = collections.defaultdict(lambda: [0] * 7)
    for part in {d[0] for d in docs}:
        for o in itertools.permutations("ABCDE"):
            left, gone = [d for d in docs if d[0] == part], []
            for step, f in enumerate(o, 1):
                now = [d for d in left if f in d[1]]
                out[part, "".join(o), step][:6] = [
                    len(left) - len(now), len(now), sum(f in d[1] for d in gone),
                    sum(d[1] == {f} for d in docs if d[0] == part), sum(d[2] for d in now), sum(d[3] for d in now)]
                left, gone = [d for d in left if f not in d[1]], gone + now
    total = collections.Counter()
    for (part, o, step), v in out.items():
        total[part, o[step - 1]] += v[1]
    return {k: (*v[:6], total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_brute_force(spark, rows):
    rng = random.Random(2)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, *_ in rows if i is not None and rng.random() < 0.6]
    labels += [labels[0], (None, 1, 1), (905, 1, 0), (905, 0, 1)]
    got = filter_audit.filter_audit(_table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == _audit(rows, labels)
    assert got.count() == 600 * len({s or "" for *_, s in rows})


def test_audit_of_empty_tables(spark, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(_table(spark, rows), none)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == _audit(rows, [])
    assert filter_audit.filter_audit(_table(spark, rows).where("false"), none).count() == 0


def test_removal_steps_are_the_min_plus_product():
    orders, masks, r = filter_audit.removal_steps(4)
    assert r.shape == (16, 24)
    for m, row in zip(masks, r):
        for o, step in zip(orders, row):
            hit = [k for k, f in enumerate(o, 1) if m[f]]
            assert step == (hit[0] if hit else 5)


# ---- 13 spelling variants --------------------------------------------------------------------

def _counts(rows, one_in=31):
    n = collections.Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = _az(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(words, ratio=10):
    form, near = {}, {}
    for w in words:
        close = [x for x in words if abs(len(x) - len(w)) < 2 and x != w and _near(w, x)]
        near[w] = len(close)
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], near[w], words.get(form[w])))
    return sorted(out)


def test_counts_against_brute_force(spark, rows):
    rows = rows + [(7, "Straße Œuvre ÀÉÎÕÜabc Kİ x×y÷zzzz", "a")] * 3 + [(8, "q" * 200 + " " + "ÿ" * 90, "a")] * 2
    for one_in in (31, 2):
        got = spelling.word_counts(_table(spark, rows), one_in=one_in).collect()
        assert {r["word"]: r["n"] for r in got} == _counts(rows, one_in)


def test_variants_of_documents_against_brute_force(spark, rows):
    got = spelling.spelling_variants(_table(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect())) == _variants(_counts(rows))
    assert spelling.spelling_variants(_table(spark, rows).where("false")).count() == 0


def test_variants_with_ties_runs_and_chains(spark):
    rng = random.Random(4)
    words = {}
    for _ in range(400):  # three letters, so neighbours by replacing, inserting and deleting in runs abound
        words["".join(rng.choice("aaé") for _ in range(rng.randint(7, 10)))] = rng.choice([2, 2, 20, 20, 200, 2000])
    words.update({"b" * 9: 2, "b" * 10: 20, "b" * 11: 200, "b" * 12: 2000, "b" * 13: 20000, "c" * 3000: 5, "c" * 3001: 50})
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(4))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(_variants(words), key=repr)
    assert {r["word"]: r["root"] for r in got.collect()}["b" * 9] == "b" * 13
