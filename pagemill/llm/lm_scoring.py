"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word of the corpus is counted exactly, in fragments of the hashes. The most frequent ones, as many as may be sent
(WORDS), have a probability of their own; all rarer ones are as probable as their mean. A network sees two words on
either side of a masked one: their embeddings, of a table for each place, are summed through tanh, and a softmax predicts
the masked word's class; classes are runs of words in order of count, of about equal sums of square-rooted counts, and
within its class a word has its share of the counts. Training reads every word of every document once: each task trains a
copy by stochastic gradient descent (AdaGrad) in numpy, and the copies are averaged, weighted by their words.

What the network can't hold, the corpus itself remembers: a word that stands c times elsewhere in the very same
surroundings (two words on either side), of n times that these surroundings come elsewhere, has the probability
(c + STRENGTH p) / (n + STRENGTH), where p is the network's. Occurrences are counted in fragments of the surroundings'
hashes, without the one that is scored; of texts with the same words in a slice one is sent, with their number. So memory grows with the corpus, and text that occurs more than once scores
higher. A document's score is the sum of the conditional log-probabilities of all its words.

Defined results: null, empty and word-less texts have n_tokens 0, log_prob 0 and a null mean; a corpus without words
gives every document these; words at the ends see padding; repeated rows are trained on and scored each; very long texts
are cut into no pieces, a slice holds at least one; a null doc_id stays; ties among words of equal count go by hash; other
columns are ignored. The table must give its rows in the same order when it is read again, as files do. Averages depend on
the number of tasks, and so do scores, a little.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._work import Scratch, fragments

BITS, WIDTH, CLASSES, SIDE = 14, 8, 64, 2
BUCKETS, BATCH, BLOCK, SLICES = 1 << BITS, 1 << 15, 2048, 16
#: Words with a probability of their own at most, those with an embedding of their own, and rows of a slice.
WORDS, DIRECT, ROWS = 1 << 21, 12288, 1 << 15
STRENGTH, STEP = 1.0, 2048.0
_EACH, _ONES, _ONE_ROW = np.arange(BLOCK), np.ones(CLASSES, np.float32), np.ones(BLOCK, np.float32)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_PAD = np.uint64(0x2545F4914F6CDD1D)
SCORES = "doc_id bigint, n_tokens bigint, log_prob double, mean_log_prob double"
COUNTED = "frag int, words binary, counts binary"
SENT = "frag int, slice bigint, rows binary, around binary, word binary, chance binary, times binary, ids binary, base binary"
GAINS = "part int, slice bigint, rows binary, gain binary, n binary, ids binary, base binary"


def _slices(batches):
    """(rows, word hashes of all, bounds) of runs of rows."""
    for part, buf, bounds in _text.slices(batches, limit=3 << 20):
        for i in range(0, part.num_rows, ROWS):
            some = part.slice(i, ROWS)
            h, _, _, offsets = _text.words(buf, bounds[i : i + some.num_rows + 1])
            yield some, h, offsets


def _sliced(flat: np.ndarray, weight: float):
    """One row for each slice of a vector, so that a shuffle can add up the slices of all tasks."""
    for k, part in enumerate(np.array_split(flat, SLICES)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([float(weight)]), pa.array([part.astype(np.float32).tobytes()], pa.binary())], ["slice", "weight", "part"])


def _summed(table: pa.Table) -> pa.Table:
    total = None
    for w, x in zip(table.column("weight").to_pylist(), table.column("part")):
        part = np.frombuffer(x.as_py(), np.float32).astype(np.float64) * w
        total = part if total is None else total + part
    return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "weight": [sum(table.column("weight").to_pylist())], "part": pa.array([total.tobytes()], pa.binary())})


def _gathered(rows: DataFrame) -> tuple[np.ndarray, float]:
    """The sum over all tasks of weight times vector, and of the weights."""
    got = sorted(rows.groupBy("slice").applyInArrow(_summed, "slice int, weight double, part binary").collect(), key=lambda r: r.slice)
    return (np.concatenate([np.frombuffer(bytes(r.part), np.float64) for r in got]), got[0].weight) if got else (np.empty(0), 0.0)


class Network:
    """A table of embeddings for each place around the masked word, one below the other, and the layer to the classes."""

    def __init__(self, prior: np.ndarray, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.embed = (rng.standard_normal((2 * SIDE * (BUCKETS + 1), WIDTH)) * 0.1).astype(np.float32)
        self.layer = (rng.standard_normal((WIDTH, CLASSES)) * 0.1).astype(np.float32)
        self.bias = np.log(prior).astype(np.float32)
        self.seen = [np.full(len(self.embed), 1e-6, np.float32), np.full_like(self.layer, 1e-6), np.full_like(self.bias, 1e-6)]

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.layer, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values and exponentials of the classes' scores, which are small enough as they are."""
        hidden = self.embed[around[0]]
        for rows in around[1:]:
            hidden += self.embed[rows]
        np.tanh(hidden, out=hidden)
        z = hidden @ self.layer
        z += self.bias
        return hidden, np.exp(z, out=z)

    def log_probs(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = np.empty(len(target))
        for a in range(0, len(target), BLOCK):
            b = min(a + BLOCK, len(target))
            _, e = self.forward(around[:, a:b])
            out[a:b] = np.log(e[_EACH[: b - a], target[a:b]] / (e @ _ONES))
        return out

    def learn(self, around: np.ndarray, target: np.ndarray, rate: float) -> None:
        n = len(target)
        by, g_layer, g_bias = np.empty((WIDTH, n), np.float32), np.zeros_like(self.layer), np.zeros_like(self.bias)
        for a in range(0, n, BLOCK):  # blocks stay in the processor's cache
            b = min(a + BLOCK, n)
            hidden, p = self.forward(around[:, a:b])
            p *= (1 / (n * (p @ _ONES)))[:, None]
            p[_EACH[: b - a], target[a:b]] -= np.float32(1 / n)
            g = p @ self.layer.T
            hidden_t = hidden.T
            g_layer += hidden_t @ p
            g_bias += _ONE_ROW[: b - a] @ p
            by[:, a:b] = g.T * (1 - hidden_t * hidden_t)
        each = 2 * SIDE
        g_embed = np.empty((len(self.embed), WIDTH), np.float32)
        for p in range(each):
            at = slice(p * (BUCKETS + 1), (p + 1) * (BUCKETS + 1))
            rows = around[p] - at.start
            for k in range(WIDTH):
                g_embed[at, k] = np.bincount(rows, by[k], BUCKETS + 1)
        self.seen[0] += np.einsum("nd,nd->n", g_embed, g_embed) / WIDTH
        g_embed *= (rate / np.sqrt(self.seen[0]))[:, None]
        self.embed -= g_embed
        for x, dx, seen in zip(self.parts()[1:], (g_layer, g_bias), self.seen[1:]):
            seen += dx * dx
            x -= rate * dx / np.sqrt(seen)


def surroundings(ids: np.ndarray, bounds: np.ndarray, none: int = BUCKETS) -> np.ndarray:
    """For each place each word's neighbour there within its text, or `none`."""
    doc = np.repeat(np.arange(SIDE, SIDE * len(bounds), SIDE), np.diff(bounds))
    at = np.arange(len(ids)) + doc
    padded = np.full(len(ids) + SIDE * (len(bounds) + 1), none, ids.dtype)
    padded[at] = ids
    return np.stack([padded[at + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))])


def _rows(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The rows of the embeddings that each word's neighbours have."""
    return surroundings(ids, bounds) + (np.arange(2 * SIDE) * (BUCKETS + 1))[:, None]


def around(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each word's surroundings."""
    return _text.mix((surroundings(h, bounds, _PAD) * _PLACES[:, None]).sum(0, dtype=np.uint64))


@dataclass
class Vocabulary:
    """Words by hash with class, log-probability within the class and embedding; what isn't there is in the last class."""

    words: np.ndarray
    kind: np.ndarray
    within: np.ndarray
    embedding: np.ndarray
    prior: np.ndarray
    rare: float

    @classmethod
    def of(cls, words: np.ndarray, count: np.ndarray, rare_words: int, rare_count: int) -> Vocabulary:
        order = np.lexsort((words, -count))
        mass = np.cumsum(np.sqrt(count[order].astype(np.float64)))
        kind, embedding = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        kind[order] = np.minimum((mass - mass[:1]) / max(mass[-1:].sum(), 1) * (CLASSES - 1), CLASSES - 2).astype(np.int64)
        embedding[order] = np.where(np.arange(len(words)) < DIRECT, np.arange(len(words)), _hashed(words[order]))
        total = np.bincount(kind, count, CLASSES)
        within = np.log(count / total[kind])
        total[-1] += rare_count
        prior = np.maximum(total, 1e-3)
        by = np.argsort(words)
        return cls(words[by], kind[by].astype(np.uint8), within[by].astype(np.float32), embedding[by].astype(np.int16), prior / prior.sum(), -np.log(max(rare_words, 1)))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding, class and log-probability within it of each word."""
        u, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, u), max(len(self.words) - 1, 0))
        known = self.words[at] == u if len(self.words) else np.zeros(len(u), bool)
        embedding, kind, within = _hashed(u), np.full(len(u), CLASSES - 1), np.full(len(u), self.rare)
        embedding[known], kind[known], within[known] = self.embedding[at[known]], self.kind[at[known]], self.within[at[known]]
        return embedding[back], kind[back], within[back]


def _hashed(h: np.ndarray) -> np.ndarray:
    return DIRECT + ((h >> np.uint64(40)) % np.uint64(BUCKETS - DIRECT)).astype(np.int64)


def _by_fragment(h: np.ndarray, count: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)


def _count(count: int):
    def run(batches):
        for _, h, _ in _slices(batches):
            words, n = np.unique(h, return_counts=True)
            edge = np.searchsorted(_by_fragment(words, count), np.arange(count + 1))
            rows = [(f, words[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes()) for f, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]
            if rows:
                yield _record(rows, COUNTED)

    return run


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), names)], [n for n, _ in names])


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() or b"" for x in column), kind)


def _counted(table: pa.Table) -> pa.Table:
    words, at = np.unique(_joined(table.column("words"), np.uint64), return_inverse=True)
    n = np.bincount(at, _joined(table.column("counts"), np.uint32), len(words)).astype(np.uint64)
    return pa.Table.from_batches([_record([(table.column("frag")[0].as_py(), words.tobytes(), n.tobytes())], COUNTED)])


def _band(n: np.ndarray) -> np.ndarray:
    """Counts in bands, of which there are few however large they get."""
    return np.where(n < 1024, n, 1024 + np.floor(16 * (np.log2(np.maximum(n, 1024)) - 10)).astype(np.int64)).astype(np.int64)


def _bands(batches):
    for batch in batches:
        n = _joined(batch.column("counts"), np.uint64).astype(np.int64)
        band, at = np.unique(_band(n), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(np.bincount(at, minlength=len(band))), pa.array(np.bincount(at, n, len(band)).astype(np.int64))], ["band", "words", "total"])


def _frequent(least: int):
    def run(batches):
        for batch in batches:
            words, n = _joined(batch.column("words"), np.uint64), _joined(batch.column("counts"), np.uint64)
            keep = _band(n.astype(np.int64)) >= least
            yield pa.RecordBatch.from_arrays([pa.array(words[keep].view(np.int64)), pa.array(n[keep].view(np.int64))], ["word", "n"])

    return run


def _train(sent, rate: float):
    def run(batches):
        vocabulary = sent.value
        net, words = Network(vocabulary.prior), 0
        for _, h, bounds in _slices(batches):
            ids, kind, _ = vocabulary.find(h)
            rows = _rows(ids, bounds)
            for a in range(0, len(ids), BATCH):
                net.learn(rows[:, a : a + BATCH], kind[a : a + BATCH], rate)
            words += len(ids)
        if words:
            yield from _sliced(net.flat(), words)

    return run


def word_log_probs(net: Network, vocabulary: Vocabulary, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each word under the network alone."""
    ids, kind, within = vocabulary.find(h)
    rows = _rows(ids, bounds)
    return np.concatenate([np.zeros(0), *(net.log_probs(rows[:, a : a + BATCH], kind[a : a + BATCH]) for a in range(0, len(ids), BATCH))]) + within


def _sent(sent, count: int, parts: int):
    """For each slice and fragment of surroundings its words, by row; behind the fragments the rows' sums under the network."""

    def run(batches):
        net, vocabulary = sent.value
        base = TaskContext.get().partitionId() << 32
        for k, (part, h, bounds) in enumerate(_slices(batches)):
            log_p = word_log_probs(net, vocabulary, h, bounds)
            where = around(h, bounds)
            first, times = _copies(where, h, bounds)
            sent_words = np.flatnonzero(np.repeat(first == np.arange(len(first)), np.diff(bounds)))
            frag = _by_fragment(where, count)
            order = np.sort(frag[sent_words].astype(np.uint64) << np.uint64(40) | sent_words.astype(np.uint64)) & np.uint64((1 << 40) - 1)
            order = order.astype(np.int64)
            edge = np.searchsorted(frag[order], np.arange(count + 1))
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[order].astype(np.uint16)
            each = times[row].astype(np.uint16) if (times > 1).any() else None
            around32, word = where[order].astype(np.uint32), (h[order] & np.uint64(0xFFFF)).astype(np.uint16)
            chance = np.minimum(np.rint(-log_p[order] * STEP), 65535).astype(np.uint16)
            rows = [(f, base + k, np.diff(row[a:b], prepend=np.uint16(0)).tobytes(), around32[a:b].tobytes(), word[a:b].tobytes(), chance[a:b].tobytes(), None if each is None or (each[a:b] == 1).all() else each[a:b].tobytes(), None, None) for f, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]
            sums = np.concatenate(([0.0], np.cumsum(log_p)))
            n = np.diff(bounds)
            ids = part.column("doc_id")
            known = np.concatenate((first, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)))
            to = int(_text.mix(np.array([base + k], np.uint64))[0] % np.uint64(parts))
            rows.append((count + to, base + k, n.astype(np.uint64).tobytes(), None, None, None, None, known.tobytes(), (sums[bounds[1:]] - sums[bounds[:-1]]).tobytes()))
            yield _record(rows, SENT)

    return run


def _remembered(count: int, parts: int):
    """One fragment: what the other occurrences of their surroundings add to the words' log-probabilities, summed per row."""

    def run(table: pa.Table) -> pa.Table:
        frag = table.column("frag")[0].as_py()
        if frag >= count:
            return pa.Table.from_batches([_record([(frag - count, s.as_py(), None, None, n.as_py(), i.as_py(), b.as_py()) for s, n, i, b in zip(*(table.column(k) for k in ("slice", "rows", "ids", "base")))], GAINS)])
        near, word = _joined(table.column("around"), np.uint32).astype(np.uint64), _joined(table.column("word"), np.uint16).astype(np.uint64)
        chance = np.exp(_joined(table.column("chance"), np.uint16) / -STEP)
        times = [np.ones(len(w.as_py()) // 2, np.int64) if t is None else np.frombuffer(t, np.uint16).astype(np.int64) for w, t in zip(table.column("word"), table.column("times").to_pylist())]
        key = near << np.uint64(16) | word
        order = np.argsort(key)
        key, times = key[order], np.concatenate(times)[order]
        same, about = (_times(x, times) for x in (key, key >> np.uint64(16)))
        many = about > 1
        at, p = order[many], chance[order[many]]
        gain = np.zeros(len(order))
        gain[at] = np.log((same[many] - 1 + STRENGTH * p) / (about[many] - 1 + STRENGTH)) - np.log(p)
        rows, a = [], 0
        for s, blob in zip(table.column("slice").to_pylist(), table.column("rows")):
            row = np.cumsum(np.frombuffer(blob.as_py(), np.uint16), dtype=np.uint16)
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            sums = np.add.reduceat(gain[a : a + len(row)], first)
            a += len(row)
            some = np.flatnonzero(sums)
            if len(some):
                to = int(_text.mix(np.array([s], np.uint64))[0] % np.uint64(parts))
                rows.append((to, s, row[first][some].tobytes(), sums[some].astype(np.float32).tobytes(), None, None, None))
        return pa.Table.from_batches([_record(rows, GAINS)]) if rows else pa.table({n: pa.array([], t) for n, t in zip(("part", "slice", "rows", "gain", "n", "ids", "base"), (pa.int32(), pa.int64(), *[pa.binary()] * 5))})

    return run


def _times(x: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each element of a sorted array is in it, if it stands for so many."""
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    return np.repeat(np.add.reduceat(times, first), np.diff(np.append(first, len(x)))) if len(x) else times


def _copies(where: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the first of those with the same words in this slice, and of how many words' worth it stands for."""
    sums = np.zeros((2, len(h) + 1), np.uint64)
    place = _text.mix(np.arange(len(h), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64))
    for k, x in enumerate((_text.mix(h ^ place), where * (place | np.uint64(1)))):
        np.cumsum(x, out=sums[k, 1:])
    key = np.stack([*(s[bounds[1:]] - s[bounds[:-1]] for s in sums), np.diff(bounds).astype(np.uint64)])
    _, first, at, times = np.unique(key, axis=1, return_index=True, return_inverse=True, return_counts=True)
    return first[at.ravel()], times[at.ravel()]


def _scores(table: pa.Table) -> pa.Table:
    """The rows of a part: what the network gives and what is remembered."""
    by: dict[int, list] = {}
    for s, *blobs in zip(table.column("slice").to_pylist(), *(table.column(k) for k in ("rows", "gain", "n", "ids", "base"))):
        by.setdefault(s, []).append([b.as_py() for b in blobs])
    out = []
    for _, pieces in sorted(by.items()):
        n, ids, base = next((np.frombuffer(p[2], np.int64), np.frombuffer(p[3], np.int64), np.frombuffer(p[4], np.float64).copy()) for p in pieces if p[2] is not None)
        for rows, gain in ((np.frombuffer(p[0], np.uint16), np.frombuffer(p[1], np.float32)) for p in pieces if p[0] is not None):
            base[rows] += gain
        first, doc, valid = np.split(ids, 3)
        base = base[first]
        base[n == 0] = 0
        out.append(pa.table({"doc_id": pa.array(doc, mask=valid == 0), "n_tokens": n, "log_prob": base, "mean_log_prob": pa.array(base / np.maximum(n, 1), mask=n == 0)}))
    return pa.concat_tables(out)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.lower("text"), F.lit("")).alias("text"))


def fit(docs: DataFrame, rate: float = 0.1, most_words: int = WORDS) -> tuple[Network, Vocabulary]:
    """The network and the vocabulary of all documents."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-words")
    count = fragments(docs, 16 << 20)
    counted = scratch.keep(_texts(docs).mapInArrow(_count(count), COUNTED).repartition(count, "frag").groupBy("frag").applyInArrow(_counted, COUNTED), "counted")
    bands = sorted(counted.mapInArrow(_bands, "band bigint, words bigint, total bigint").groupBy("band").agg(F.sum("words").alias("words"), F.sum("total").alias("total")).collect(), reverse=True)  # a few thousand
    held, least = 0, 1 << 62
    for b in bands:
        if held + b.words > most_words:
            break
        held, least = held + b.words, b.band
    rest = [b for b in bands if b.band < least]
    table = counted.mapInArrow(_frequent(least), "word bigint, n bigint").toArrow()  # most_words rows at most
    vocabulary = Vocabulary.of(table.column("word").to_numpy().view(np.uint64), table.column("n").to_numpy(), sum(b.words for b in rest), sum(b.total for b in rest))
    flat, weight = _gathered(_texts(docs).mapInArrow(_train(spark.sparkContext.broadcast(vocabulary), rate), "slice int, weight double, part binary"))
    net = Network(vocabulary.prior)
    if weight:
        net.load(flat / weight)
    net.seen = []
    return net, vocabulary


def score(docs: DataFrame, model: tuple[Network, Vocabulary] | None = None) -> DataFrame:
    """Log-probability of every document under a network trained on all of them and what the corpus remembers."""
    spark = docs.sparkSession
    model = model or fit(docs)
    count = fragments(docs, 6 << 20)
    parts = max(4, count // 4)
    sent = _texts(docs).mapInArrow(_sent(spark.sparkContext.broadcast(model), count, parts), SENT).repartition(count, "frag").groupBy("frag").applyInArrow(_remembered(count, parts), GAINS)
    return sent.repartition(parts, "part").groupBy("part").applyInArrow(_scores, SCORES)


def op2_masked_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
