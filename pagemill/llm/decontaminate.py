"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, shared word pairs, exact check.

Items are put into classes of window size (each size at least 3/4 of an item's length). The first, middle and last
window of an item are fingerprinted: 64 bits, each the majority over the window's word pairs. Every window of every text,
at every word, gets the same fingerprint from one running sum per bit. A fingerprint within `radius` of another has one
of its four 16-bit blocks within about radius / 4 (the bounds of the blocks add up to radius - 3), so tables of all such
block values find every one of them.

Fingerprints alone lose near copies, so a second, exact search goes over the word pairs themselves. A window as similar
as the threshold t shares pairs of at least t of an item's weight, so of the item's rarest pairs that have 1 - t / 2 of
its weight it shares at least t / 2. All stretches of a text with so much of an item's rare pairs are found by a running
sum over its hits, and every window of theirs is tried: no window at or above the threshold is lost.

What is found is verified with the weighted similarity of word-pair multisets (weight: the pair's length in bytes) between the item
and the item-sized window of the text: sum of w min(x, y) over sum of w max(x, y).

Items of fewer than `short` words, in which a single other word is most of the item, are found as exact copies of their
sequence of words, down to one word. (A benchmark of single words so takes every document that has one.)

Defined results: null, empty and word-less texts hold nothing; null and word-less items are nowhere; texts however long
are searched whole, in runs of words; of an item that occurs more than once in a text the most similar window
is reported, of ties the first; repeated rows are reported each; other columns, whatever their names, are ignored by
leaks() and kept by remove_leaks(), which keeps rows with a null doc_id too. An empty benchmark leaks nowhere.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ..shared import ship
from ._work import SEND_LIMIT, size_in_bytes

LEAKS = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, similarity double"
BLOCKS, BLOCK_BITS, RUN, CHUNK = 4, 16, 256, 1 << 15
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _pairs(h: np.ndarray) -> np.ndarray:
    return _text.mix(h[:-1] * _PAIR + h[1:]) if len(h) > 1 else np.empty(0, np.uint64)


def _sequences(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = _text.mix(out * _PAIR + h[k : k + len(out)])
    return out


def _running(g: np.ndarray, widest: int) -> np.ndarray:
    """Per bit, how many of the pairs so far have it; counts wrap around, differences within a window don't."""
    kind = np.uint8 if widest < 256 else np.uint32
    runs = -(-len(g) // RUN)
    sums = np.zeros((runs * RUN + 1, 64), kind)
    sums[1 : len(g) + 1] = np.unpackbits(g.view(np.uint8)).reshape(-1, 64)
    table = sums[1:].reshape(runs, RUN, 64)
    for k in range(1, RUN):  # all runs side by side, then each run on top of those before it
        table[:, k] += table[:, k - 1]
    table[1:] += np.cumsum(table[:-1, -1], axis=0, dtype=kind)[:, None]
    return sums[: len(g) + 1]


def _fingerprints(sums: np.ndarray, size: int) -> np.ndarray:
    """One fingerprint for each window of `size` words."""
    pairs = size - 1
    if len(sums) <= pairs:
        return np.empty(0, np.uint64)
    return np.packbits((sums[pairs:] - sums[:-pairs] > pairs // 2).reshape(-1)).view(np.uint64)


def fingerprints(h: np.ndarray, size: int) -> np.ndarray:
    return _fingerprints(_running(_pairs(h), size), size)


def _near_blocks(radius: int, block: int) -> np.ndarray:
    """The 16-bit patterns in which this block may differ. Were all blocks to differ in more bits, the sum would be above the radius."""
    most = (radius + 1 - BLOCKS + BLOCKS - 1 - block) // BLOCKS
    flips = [sum(1 << b for b in bits) for n in range(min(most, BLOCK_BITS) + 1) for bits in itertools.combinations(range(BLOCK_BITS), n)]
    return np.array(flips, np.int64)


class _Class:
    """The anchors of one window size and, per block, which of them are near each block value."""

    def __init__(self, size: int, anchors: list[tuple[int, int, int]], radius: int):
        self.size = size
        self.item = np.array([a[0] for a in anchors])
        self.offset = np.array([a[1] for a in anchors])
        self.print = np.array([a[2] for a in anchors], np.uint64)
        self.ends, self.members, self.any = [], [], []
        for b in range(BLOCKS):
            near = _near_blocks(radius, b)
            own = self.print.view(np.uint16).reshape(-1, BLOCKS)[:, b].astype(np.int64)
            values = (own[:, None] ^ near[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            self.members.append(np.repeat(np.arange(len(own)), len(near))[order].astype(np.int32))
            self.ends.append(np.concatenate(([0], np.cumsum(np.bincount(values, minlength=1 << BLOCK_BITS)))).astype(np.int32))
            self.any.append(np.diff(self.ends[-1]) > 0)

    def search(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (window, anchor) within the radius; a pair may come more than once."""
        windows, anchors = [], []
        parts = prints.view(np.uint16).reshape(-1, BLOCKS)
        for b in range(BLOCKS):
            value = parts[:, b].astype(np.intp)
            at = np.flatnonzero(self.any[b][value])
            value = value[at]
            first = self.ends[b][value]
            n = self.ends[b][value + 1] - first
            w = np.repeat(at, n)
            a = self.members[b][np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(w))]
            close = np.bitwise_count(prints[w] ^ self.print[a]) <= radius
            windows.append(w[close])
            anchors.append(a[close])
        return np.concatenate(windows), np.concatenate(anchors)


class _Rare:
    """Of each item the rarest pairs, and how much of their weight a window of the item's similarity must have."""

    def __init__(self, items: list[tuple], threshold: float):
        spread: dict[int, int] = {}
        for _, _, count, _, _ in items:
            for x in count:
                spread[x] = spread.get(x, 0) + 1
        keys, owners, weights, self.demand = [], [], [], np.zeros(len(items))
        for k, (_, _, count, weight, total) in enumerate(items):
            held = 0
            for x in sorted(count, key=lambda x: (spread[x], -weight[x], x)):
                keys.append(x)
                owners.append(k)
                weights.append(weight[x])
                held += count[x] * weight[x]
                if held >= (1 - threshold / 2) * total:
                    break
            self.demand[k] = (held - (1 - threshold) * total) * (1 - 1e-9)
        self.pairs = np.array([len(h) - 1 for _, h, *_ in items], np.int64)
        key = np.array(keys, np.uint64)
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.ends = np.append(first, len(order))
        self.owner, self.weight = np.array(owners, np.int64)[order], np.array(weights, np.int64)[order]
        bits = max(12, (16 * len(self.keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.any = np.zeros(1 << bits, bool)
        self.any[self.keys >> self.shift] = True

    def search(self, g: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (item, pair) at which a stretch of the item's length begins that has what is demanded, in order.

        The pairs g of a text end before stop; one that joins two texts lies at or behind its own.
        """
        at = np.flatnonzero(self.any[g >> self.shift])
        at = at[at < stop[at]]
        found = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        same = self.keys[found] == g[at]
        at, found = at[same], found[same]
        n = self.ends[found + 1] - self.ends[found]
        posting = np.repeat(self.ends[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at, item = np.repeat(at, n), self.owner[posting]
        width = len(g) + 1
        key = item * width + at
        order = np.argsort(key, kind="stable")
        key, at, item = key[order], at[order], item[order]
        sums = np.concatenate(([0], np.cumsum(self.weight[posting][order])))
        last = np.searchsorted(key, item * width + np.minimum(at + self.pairs[item], stop[at]))
        enough = sums[last] - sums[:-1] >= self.demand[item]
        return item[enough], at[enough]


class Index:
    """Everything that a search for some benchmark items needs."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = 0.6, short: int = 8, radius: int = 9, ratio: float = 4 / 3):
        self.threshold, self.radius, self.items = threshold, radius, []
        brief: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in sorted((i, t) for i, t in items if i is not None and t):
            raw = np.frombuffer(text.lower().encode(), np.uint8)
            h, s, e, _ = _text.words(raw, np.array([0, len(raw)]))
            if 0 < len(h) < max(2, short):
                brief.setdefault(len(h), []).append((item_id, h))
            elif len(h):
                g = _pairs(h)
                length = e - s
                weight = dict(zip(g.tolist(), (length[:-1] + length[1:]).tolist()))
                count: dict[int, int] = {}
                for x in g.tolist():
                    count[x] = count.get(x, 0) + 1
                self.items.append((item_id, h, count, weight, sum(n * weight[x] for x, n in count.items())))
        self.brief = {}
        for n, own in brief.items():
            key = np.array([_sequences(h, n)[0] for _, h in own], np.uint64)
            order = np.argsort(key, kind="stable")
            self.brief[n] = key[order], [own[k] for k in order.tolist()]
        lengths = sorted({len(i[1]) for i in self.items})
        sizes: list[int] = []
        for n in lengths:
            if not sizes or n >= math.ceil(sizes[-1] * ratio):
                sizes.append(n)
        self.widest = max(lengths, default=2)
        by: dict[int, list[tuple[int, int, int]]] = {s: [] for s in sizes}
        for k, (_, h, *_) in enumerate(self.items):
            size = max(s for s in sizes if s <= len(h))
            prints = fingerprints(h, size)
            by[size] += [(k, o, int(prints[o])) for o in sorted({0, (len(h) - size) // 2, len(h) - size})]
        self.classes = [_Class(s, a, radius) for s, a in by.items()]
        self.rare = _Rare(self.items, threshold)

    def similarity(self, k: int, g: np.ndarray, length: np.ndarray) -> float:
        """Of item k and the window with these pairs and word lengths."""
        _, _, count, weight, total = self.items[k]
        own: dict[int, int] = {}
        common = window = 0
        for x, w in zip(g.tolist(), (length[:-1] + length[1:]).tolist()):
            window += w
            if x in count:
                own[x] = own.get(x, 0) + 1
                if own[x] <= count[x]:
                    common += weight[x]
        return common / (total + window - common) if common else 0.0

    def most_similar(self, k: int, g: list[int], weights: list[int], first: int) -> tuple[float, int]:
        """(similarity, first word) of item k's best window of these pairs, of ties the first; the pairs begin at `first`."""
        _, h, count, weight, total = self.items[k]
        own: dict[int, int] = {}
        common = window = best = at = 0
        pairs = len(h) - 1
        for j, (x, w) in enumerate(zip(g, weights)):
            window += w
            if x in count:
                own[x] = own.get(x, 0) + 1
                if own[x] <= count[x]:
                    common += weight[x]
            if j >= pairs:
                old = g[j - pairs]
                window -= weights[j - pairs]
                if old in count:
                    if own[old] <= count[old]:
                        common -= weight[old]
                    own[old] -= 1
            if j >= pairs - 1 or j == len(g) - 1:  # a text shorter than the item is one window
                similarity = common / (total + window - common)
                if similarity > best:
                    best, at = similarity, max(0, j - pairs + 1)
        return best, first + at

    def find(self, h: np.ndarray, length: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity), the best window of each text and item."""
        seen: set[tuple[int, int]] = set()
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        copies = self._copies(h, offsets)
        if not self.items:
            return copies
        threshold = self.threshold
        end_of = np.repeat(offsets[1:], np.diff(offsets))
        for a in range(0, len(h), CHUNK):
            part = h[a : a + CHUNK + self.widest]
            g = _pairs(part)
            if not len(g):
                continue
            done: tuple[int, int, int] = (-1, -1, -1)
            for k, p in zip(*(x.tolist() for x in self.rare.search(g, end_of[a : a + len(g)] - a - 1))):
                d = int(np.searchsorted(offsets, p + a, "right")) - 1
                n, begin, end = len(self.items[k][1]), int(offsets[d]), int(offsets[d + 1])
                first = max(begin, p + a - n + 2, done[2] if done[:2] == (k, d) else 0)
                last = max(begin, min(p + a, end - n))
                if first > last:
                    first = last
                done = k, d, last + 1
                stop = min(last + n, end)
                sim, at = self.most_similar(k, _pairs(h[first:stop]).tolist(), (length[first : stop - 1] + length[first + 1 : stop]).tolist(), first)
                if sim >= threshold:
                    new = (-sim, at - begin, min(at + n, end) - at)
                    best[d, k] = min(best.get((d, k), new), new)
            sums = _running(g, self.widest)
            for c in self.classes:
                prints = _fingerprints(sums, c.size)[:CHUNK]
                if not len(prints):
                    continue
                at, anchor = c.search(prints, self.radius)
                if not len(at):
                    continue
                at = at + a
                doc = np.searchsorted(offsets, at, "right") - 1
                inside = at + c.size <= offsets[doc + 1]
                for p, d, x in zip(at[inside].tolist(), doc[inside].tolist(), anchor[inside].tolist()):
                    k = int(c.item[x])
                    n = len(self.items[k][1])
                    first = max(int(offsets[d]), min(p - int(c.offset[x]), int(offsets[d + 1]) - n))
                    if (k, first) in seen:
                        continue
                    seen.add((k, first))
                    end = min(first + n, int(offsets[d + 1]))
                    sim = self.similarity(k, _pairs(h[first:end]), length[first:end])
                    if sim >= threshold:
                        new = (-sim, first - int(offsets[d]), end - first)
                        best[d, k] = min(best.get((d, k), new), new)
        return copies + [(d, self.items[k][0], first, n, -sim) for (d, k), (sim, first, n) in sorted(best.items())]

    def _copies(self, h: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """The first exact copy of each short item in each text."""
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for n, (keys, items) in self.brief.items():
            g = _sequences(h, n)
            low = np.searchsorted(keys, g)
            for p in np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == g).tolist():
                d = int(np.searchsorted(offsets, p, "right")) - 1
                if p + n > offsets[d + 1]:
                    continue
                for item_id, own in items[int(low[p]) : int(np.searchsorted(keys, g[p], "right"))]:
                    if (own == h[p : p + n]).all():
                        out.setdefault((d, item_id), (p - int(offsets[d]), n))
        return [(d, item_id, first, n, 1.0) for (d, item_id), (first, n) in sorted(out.items())]


def _indexes(docs: DataFrame, benchmark: DataFrame, send_limit: int, **options):
    """Broadcast indexes of parts of the benchmark, each of a size that may be sent."""
    ship(docs.sparkSession)
    items = benchmark.select("item_id", "text")
    parts = max(1, -(-size_in_bytes(items) * 32 // send_limit))  # tables and strings take about so much
    for p in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p)
        yield docs.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in mine.toLocalIterator()], **options))


def _search(index: Index, buf: np.ndarray, bounds: np.ndarray):
    h, s, e, offsets = _text.words(buf, bounds)
    return index.find(h, e - s, offsets)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, send_limit: int = SEND_LIMIT, **options) -> DataFrame:
    """The items that each text holds. Narrow: no text and no fingerprint is shuffled."""
    texts = docs.select("doc_id", F.lower("text").alias("text")).where("text IS NOT NULL")
    out = None
    for sent in _indexes(docs, benchmark, send_limit, threshold=threshold, **options):

        def run(batches, sent=sent):
            for part, buf, bounds in _text.slices(batches):
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[d], *x) for d, *x in _search(sent.value, buf, bounds)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        one = texts.mapInArrow(run, LEAKS)
        out = one if out is None else out.unionByName(one)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, send_limit: int = SEND_LIMIT, **options) -> DataFrame:
    """The rows of documents that hold no item, with all their columns."""
    for sent in _indexes(docs, benchmark, send_limit, threshold=threshold, **options):

        def run(batches, sent=sent):
            for part, buf, bounds in _text.slices(batches, None):
                keep = np.ones(part.num_rows, bool)
                keep[[d for d, *_ in _search(sent.value, buf, bounds)]] = False
                yield _text.kept(part, keep)

        docs = _text.with_lower(docs).mapInArrow(run, docs.schema)
    return docs


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
