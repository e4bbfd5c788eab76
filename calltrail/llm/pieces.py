"""Operator 9, SentencePiece encoding and decoding: N-best segmentation.

The lattice of a text holds every vocabulary piece that matches at some place,
with the score that the model file gives it; a character that no piece covers
costs the lowest score of a piece with letters less 10 and is written as its
byte pieces.  The
score of a segmentation is the sum over its pieces.  Forward Viterbi scores are
the exact best score of every prefix, so a backward A* search that uses them as
heuristic meets complete segmentations in the order of their scores.

No piece of the usual models reaches over a blank mark that follows another
character, so the lattice falls apart into chunks there.  Viterbi runs
over all new chunks of a batch at once, in numpy; forward and backward scores
also tell how much a chunk's second best segmentation loses.  The N best of
a text differ from the best in the N - 1 chunks that lose least, so A* runs on
those alone and the result is still exact.  A model whose pieces do cross blanks
has one chunk per text.
"""

from __future__ import annotations

import heapq
import re
import zlib
from itertools import chain, product, repeat
from math import prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from calltrail.llm.base import mix64

BLANK = "▁"
N_BEST = 4
#: Chunks kept with their segmentation per task.
CACHE_CHUNKS = 600_000
#: Longer chunks (text without blanks) are searched one by one.
LONG_CHUNK = 4096
UNKNOWN_PENALTY = 10.0


class Pieces:
    """The vocabulary of a SentencePiece model file and its lattice search."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score, self.bytes_of, self.text = {}, [0] * 256, []
        self.id = {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[int(p[3:5], 16)] = i
                self.text.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                self.id[p], self.score[p] = i, sp.get_score(i)
                self.text.append(p.replace(BLANK, " ").encode())
        self.longest = max(map(len, self.id))
        # runs of blank marks hold a placeholder score in some models
        self.unknown = min((s for p, s in self.score.items() if p.strip(BLANK)), default=0.0) - UNKNOWN_PENALTY
        crossing = any(BLANK in p.lstrip(BLANK) for p in self.id)
        breaks = any("\n" in p for p in self.id)
        pattern = (r"(?s).+" if crossing else f"{BLANK}*[^{BLANK}]+|{BLANK}+" if breaks
                   else f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
        self.chunks = re.compile(pattern).findall
        keys, values = [], []
        size = self.longest + 1
        self.up = np.full(size, 0x9E3779B97F4A7C15, np.uint64)
        self.up[0] = 1
        self.up = np.multiply.accumulate(self.up)
        for p, i in self.id.items():
            c = np.array([ord(x) + 1 for x in p], np.uint64)
            keys.append((c * self.up[:len(c)]).sum(dtype=np.uint64) + np.uint64(len(c) << 40))
            values.append(i)
        self._fill(mix64(np.array(keys, np.uint64)), np.array(values, np.int32))
        self.score_of = np.array([self.score.get(sp.id_to_piece(i), -np.inf) for i in range(sp.get_piece_size())] +
                                 [-np.inf])

    # piece lookup in bulk: open addressing
    def _fill(self, keys, values):
        bits = int(4 * len(keys)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_id = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        slot = (keys >> self.shift).astype(np.int64)
        while len(keys):
            free = self.slot_id[slot] < 0
            self.slot_key[slot[free]], self.slot_id[slot[free]] = keys[free], values[free]
            left = self.slot_key[slot] != keys
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def _find(self, keys):
        slot = (keys >> self.shift).astype(np.int64)
        out = np.where(self.slot_key[slot] == keys, self.slot_id[slot], -1)
        left = np.flatnonzero((self.slot_key[slot] != keys) & (self.slot_id[slot] >= 0))
        at = slot[left]
        while len(left):
            at = (at + 1) & self.mask
            hit = self.slot_key[at] == keys[left]
            out[left[hit]] = self.slot_id[at[hit]]
            more = ~hit & (self.slot_id[at] >= 0)
            left, at = left[more], at[more]
        return out

    def best(self, chunks: list[str]):
        """The best segmentation of each chunk: ids of all of them (uint32) and,
        by chunk, where its ids begin, how many they are, the score, and what the second
        best loses (inf if there is none)."""
        order = sorted(range(len(chunks)), key=lambda i: len(chunks[i]))
        flat, done, ends = [], [], 0
        at = 0
        while at < len(order):
            size = 1
            while at + size < len(order) and (size + 1) * len(chunks[order[at + size]]) <= 10_000:
                size += 1
            ids, n, score, loss = self._viterbi([chunks[i] for i in order[at:at + size]])
            flat.append(ids)
            done.append((ends + np.cumsum(n) - n, n, score, loss))
            ends += len(ids)
            at += size
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return (np.concatenate(flat), *(np.concatenate(c)[back] for c in zip(*done)))

    def _viterbi(self, chunks):
        n = len(chunks)
        size = np.array([len(c) for c in chunks])
        top = int(size.max())
        m = min(self.longest, top)
        code = np.zeros((n, top + m), np.uint64)  # m columns of padding after the text
        flat = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        inside = np.arange(top)[None, :] < size[:, None]
        code[:, :top][inside] = flat
        # piece[w, i, l - 1]: the piece of l characters from i on
        piece = np.full((n, top, m), -1, np.int32)
        key = np.zeros((n, top), np.uint64)
        for k in range(1, m + 1):
            key = key + code[:, k - 1:k - 1 + top] * self.up[k - 1]
            ok = np.arange(top)[None, :] + k <= size[:, None]
            if not ok.any():
                break
            piece[:, :, k - 1][ok] = self._find(mix64(key[ok] + np.uint64(k << 40)))
        cost = self.score_of[piece]  # -1 is the last entry: -inf
        single = cost[:, :, 0]
        single[(piece[:, :, 0] < 0) & inside] = self.unknown
        ahead = np.full((n, top + 1 + m), -np.inf)  # best score of the suffix from i on
        ahead[np.arange(n), size] = 0.0
        for i in range(top - 1, -1, -1):
            live = i < size
            ahead[live, i] = (cost[live, i] + ahead[live, i + 1:i + 1 + m]).max(1)
        prefix = np.full((n, top + 1 + m), -np.inf)
        prefix[:, 0] = 0.0
        for i in range(top):
            reach = prefix[:, i, None] + cost[:, i]
            np.maximum(prefix[:, i + 1:i + 1 + m], reach, out=prefix[:, i + 1:i + 1 + m])
        total = ahead[:, 0]
        # best score through each edge; those of the best path are taken out
        follow = np.lib.stride_tricks.sliding_window_view(ahead[:, 1:], m, axis=1)[:, :top]
        through = prefix[:, :top, None] + cost + follow
        pos, ids, steps = np.zeros(n, np.int64), [], []
        active = pos < size
        w = np.arange(n)
        while active.any():
            a = w[active]
            p = pos[a]
            pick = (cost[a, p] + follow[a, p]).argmax(1)
            through[a, p, pick] = -np.inf
            row = np.full(n, -2, np.int64)
            row[a] = piece[a, p, pick]
            ids.append(row), steps.append(pos.copy())
            pos[a] += pick + 1
            active = pos < size
        second = through.reshape(n, -1).max(1)
        ids = np.stack(ids, 1)
        used = ids != -2
        flat, count = ids[used], used.sum(1)
        if (flat == -1).any():  # characters that no piece covers
            places = np.stack(steps, 1)[used]
            rows = np.repeat(np.arange(n), count)
            parts = [[j] if j >= 0 else self.byte_ids(chunks[r][p]) for j, p, r in zip(flat.tolist(), places.tolist(), rows.tolist())]
            count = np.bincount(rows, [len(x) for x in parts], n).astype(np.int64)
            flat = np.array([x for part in parts for x in part])
        return flat.astype(np.uint32), count, total, total - second

    def byte_ids(self, char: str) -> list[int]:
        return [self.bytes_of[b] for b in char.encode("utf-8", "replace")]

    def n_best(self, chunk: str, n: int) -> list[tuple[float, tuple]]:
        """The n best (score, ids): forward Viterbi, then backward A*.

        The search keeps back pointers, one per state met.  As the forward scores
        are exact, a state's score is that of the best whole segmentation through it; every
        step off the best way on is one more of them, so states that do not beat the
        n-th best score met so far are not kept.  Work grows with the length of the chunk.
        """
        m, size, score, unknown = self.longest, len(chunk), self.score, self.unknown
        best = [0.0] + [-np.inf] * size
        for j in range(1, size + 1):
            top = best[j]
            for i in range(max(0, j - m), j):
                s = score.get(chunk[i:j])
                if s is None and i == j - 1:
                    s = unknown
                if s is not None and best[i] + s > top:
                    top = best[i] + s
            best[j] = top
        # a state: where the rest begins, the rest's score, the state it came from
        at, rest, came, out = [size], [0.0], [-1], []
        heap, top, into = [(-best[size], 0)], [best[size]], {}
        while heap and len(out) < n:
            node = -heapq.heappop(heap)[1]
            j, g = at[node], rest[node]
            if j == 0:
                ids = []
                while came[node] >= 0:
                    piece = chunk[at[node]:at[came[node]]]
                    ids.extend([self.id[piece]] if piece in self.id else self.byte_ids(piece))
                    node = came[node]
                out.append((g, tuple(ids)))
                continue
            ways = into.get(j)
            if ways is None:
                ways = []
                for i in range(max(0, j - m), j):
                    s = score.get(chunk[i:j])
                    if s is None and i == j - 1:
                        s = unknown
                    if s is not None:
                        ways.append((s + best[i], s, i))
                ways.sort(reverse=True)
                ways = into[j] = ways[:n]  # n are enough: each is a segmentation of its own
            for k, (total, s, i) in enumerate(ways):
                total += g
                if k:
                    if len(top) == n and total <= top[0]:
                        break
                    (heapq.heappush if len(top) < n else heapq.heappushpop)(top, total)
                at.append(i), rest.append(g + s), came.append(node)
                heapq.heappush(heap, (-total, 1 - len(at)))  # of equal scores the latest: it is furthest
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Segmenter:
    """N-best segmentation of texts, with the chunks met so far: their numbers,
    and by number their ids (a stretch of one array), score, loss, and whether the
    ids spell the chunk."""

    def __init__(self, pieces: Pieces, n: int):
        self.pieces, self.n, self.choices = pieces, n, {}
        self.length = np.array([len(t) for t in pieces.text], np.int64)
        self._forget()

    def _forget(self):
        self.known, self.lists, self.kept = {}, {}, 0
        self.ids = [np.zeros(0, np.uint32)]
        self.table = [np.zeros((0, 5))]  # begin, size, score, loss, spelt

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """The chunks' numbers; those not met before are searched."""
        out = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        for _ in range(2):
            left = np.flatnonzero(out < 0)
            if not len(left):
                break
            new = list(dict.fromkeys(map(chunks.__getitem__, left.tolist())))
            room = sum(map(len, new))
            if self.known and (len(self.known) + len(new) > CACHE_CHUNKS or self.kept + room > 10 * CACHE_CHUNKS):
                self._forget()
                out[:] = -1
                continue
            self.kept += room
            self._learn(new)
            out[left] = np.fromiter(map(self.known.__getitem__, map(chunks.__getitem__, left.tolist())), np.int64, len(left))
        return out

    def _learn(self, new):
        begin = sum(map(len, self.ids))
        for c in [c for c in new if len(c) > LONG_CHUNK]:
            found = self.lists[c] = self.pieces.n_best(c, max(self.n, 2))
            score, ids = found[0]
            loss = score - found[1][0] if len(found) > 1 else np.inf
            self.known[c] = len(self.known)
            self.ids.append(np.array(ids, np.uint32))
            self.table.append(np.array([[begin, len(ids), score, loss, self._spells(c, ids)]], float))
            begin += len(ids)
        new = [c for c in new if len(c) <= LONG_CHUNK]
        if new:
            flat, at, size, score, loss = self.pieces.best(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.ids.append(flat)
            self.table.append(np.stack([at + begin, size, score, loss, self._all_spelt(new, flat, at, size)], 1))
        self.ids, self.table = [np.concatenate(self.ids)], [np.concatenate(self.table)]

    def _spells(self, chunk: str, ids) -> bool:
        return b"".join(map(self.pieces.text.__getitem__, ids)) == _bytes(chunk)

    def _all_spelt(self, chunks, flat, at, size):
        want = list(map(_bytes, chunks))
        out = np.concatenate([[0], np.cumsum(self.length[flat])])
        have = b"".join(map(self.pieces.text.__getitem__, flat.tolist()))
        return [have[a:b] == w for a, b, w in zip(out[at].tolist(), out[at + size].tolist(), want)]

    def run(self, texts: list[str]):
        """For each text its segmentations, best first: (score, ids as bytes,
        whether they decode to the text).  That is checked by chunk, once for each
        segmentation met; a text that holds the blank mark itself does not come back."""
        cut = [self.pieces.chunks(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        numbers = self._numbers(list(chain.from_iterable(cut)))
        own = self.table[0][numbers]
        size = own[:, 1].astype(np.int64)
        place = np.concatenate([[0], np.cumsum(size)])  # of each chunk's ids among those of all texts
        raw = self.ids[0][np.arange(place[-1]) + np.repeat(own[:, 0].astype(np.int64) - place[:-1], size)].astype("<u4").tobytes()
        first = np.cumsum([0] + [len(cs) for cs in cut]).tolist()
        for text, cs, a, b in zip(texts, cut, first, first[1:]):
            total, whole = float(own[a:b, 2].sum()), bool(own[a:b, 4].all()) and BLANK not in (text or "")
            least = own[a:b, 3]
            if len(least) > self.n - 1:  # ties go to the chunks in front
                edge = np.partition(least, self.n - 2)[self.n - 2] if self.n > 1 else -np.inf
                near = np.flatnonzero(least <= edge)
            else:
                near = np.arange(len(least))
            few = [int(i) for i in near[np.argsort(least[near], kind="stable")][:self.n - 1] if least[i] < np.inf]
            options = []
            for i in few:
                c = cs[i]
                if c not in self.lists:
                    if len(self.lists) >= CACHE_CHUNKS:
                        self.lists = {}
                    self.lists[c] = self.pieces.n_best(c, self.n)
                whole = whole and all(self._spells(c, x) for _, x in self.lists[c])
                options.append([(own[a + i, 2] - s, x) for s, x in self.lists[c]])
            # a choice of the p-th, q-th, ... of its chunks is one of p * q * ... that are as good
            ways = sorted((sum(o[0] for o in way), [o[1] for o in way])
                          for way in (tuple(o[k] for o, k in zip(options, ks)) for ks in self._choices(options)))[:self.n]
            result = [(total, raw[4 * place[a]:4 * place[b]], whole)]
            for loss, way in ways[1:]:
                parts, at = [], place[a]
                for i, x in sorted(zip(few, way)):
                    parts += [raw[4 * at:4 * place[a + i]], np.array(x, "<u4").tobytes()]
                    at = place[a + i + 1]
                result.append((total - loss, b"".join([*parts, raw[4 * at:4 * place[b]]]), whole))
            yield result

    def _choices(self, options):
        sizes = tuple(map(len, options))
        if sizes not in self.choices:
            self.choices[sizes] = [ks for ks in product(*map(range, sizes)) if prod(k + 1 for k in ks) <= self.n]
        return self.choices[sizes]


def _bytes(chunk: str) -> bytes:
    return chunk.replace(BLANK, " ").encode("utf-8", "replace")


def encode_n_best(docs: DataFrame, model: str, n: int = N_BEST, with_ids: bool = True) -> DataFrame:
    """The n best segmentations of every whole text: doc_id, rank (from 1),
    score, n_pieces, ids_crc32 (ids as little-endian uint32), round_trip (the
    decoded ids are the text), and with `with_ids` the ids.

    model: path of a SentencePiece model file.  Text is taken as it is, with
    blanks marked and one mark in front.  A null or empty text has one
    segmentation, without pieces.  Equal scores are ordered by the ids of the
    chunks that differ.  Fewer rows come out if a text has fewer segmentations.
    """
    schema = ("doc_id long, rank int, score double, n_pieces long, ids_crc32 long, round_trip boolean"
              + (", ids array<int>" if with_ids else ""))

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        segmenter = Segmenter(Pieces(model), n)
        for b in batches:
            ids, texts = b["doc_id"].to_pylist(), [t or "" for t in b["text"].to_pylist()]
            at = 0
            while at < len(texts):  # runs of about 500,000 characters bound the arrays
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= 500_000):
                    chars += len(texts[to])
                    to += 1
                rows, raws = [], []
                for i, found in zip(ids[at:to], segmenter.run(texts[at:to])):
                    for rank, (score, raw, whole) in enumerate(found, 1):
                        rows.append((i, rank, score, len(raw) // 4, zlib.crc32(raw), whole))
                        raws.append(raw)
                types = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
                out = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                if with_ids:
                    ends = np.cumsum([0] + [r[3] for r in rows]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raws), "<i4"))))
                yield pa.RecordBatch.from_arrays(out, names)
                at = to

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with its `ids` (array<int>; null counts as empty) decoded into
    `text`; other columns stay.  Ids outside the vocabulary raise an error."""
    def run(series):
        pieces = Pieces(model)
        for s in series:
            yield pd.Series([pieces.decode([] if x is None else list(x)) for x in s])

    from collections.abc import Iterator
    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return encoded.withColumn("text", F.pandas_udf(run, "string")(F.col("ids")))
