"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's features are its byte n-grams (2 to 4 bytes, letters only, the rest as blanks) hashed to rows of an embedding
table; their average goes through a linear layer. Table and layer are trained by stochastic gradient descent in numpy on
labelled rows: about `most_docs` documents at most, drawn by a hash of their id and text, cut into pieces of 4 to 60 words so that short
texts are learnt too. Every fifth document is held out; on these, whole as the texts to be judged are, the temperature of
the probabilities and the least probability at which a language is accepted are set, so that the share of errors among
what is accepted is at most `most_errors`; that probability is at least `floor`, by default 1.2 times a blind guess's.
For scoring, table and layer are multiplied out: a text's scores are the mean of one short row for each n-gram.

Defined results: null, empty and letterless texts are rejected, with a null language and probability 0; so is every text
below the accepted probability (its best language is still named); a table without any label rejects all; of languages
with equal scores the first in the alphabet is taken; very long texts are scored whole, in pieces; repeated rows are
scored each; a null doc_id stays; other columns
are ignored by identify() and kept by keep_identified().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import ship
from . import _text

ROWS, WIDTH, SIZES = 1 << 16, 8, (2, 3, 4)
PIECE = 1 << 16
_LETTER = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
IDENTIFIED = "doc_id bigint, language string, probability double, accepted boolean"


def _rows(raw: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
    """For each n the row of the n-gram at each byte; ROWS, a row of zeros, where it would leave the text or is blank."""
    x = np.frombuffer(raw.tobytes().translate(_LETTER), np.uint8).astype(np.uint32)
    x = np.concatenate((x, np.full(SIZES[-1], 32, np.uint32)))
    n = len(raw)
    code, out = x[:n].copy(), []
    for k in range(1, SIZES[-1]):
        code |= x[k : n + k] << np.uint32(8 * k)
        row = ((code + np.uint32(k * 0x3C6EF35F)) * np.uint32(0x9E3779B1)) >> np.uint32(16)
        blank = (x[:n] == 32) & (x[1 : n + 1] == 32)
        row[(inside < k) | blank] = ROWS
        out.append(row.astype(np.intp))
    return out


def _inside(bounds: np.ndarray, a: int, b: int) -> np.ndarray:
    """How many bytes of the same text follow each byte from a to b."""
    ends = bounds[np.searchsorted(bounds, a, "right") : np.searchsorted(bounds, b, "left") + 1]
    return np.repeat(ends, np.diff(np.minimum(ends, b), prepend=a)) - np.arange(a + 1, b + 1)


def sums(buf: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sum of its n-grams' table rows and their number; pieces bound the memory of long texts."""
    total = np.zeros((len(bounds) - 1, table.shape[1]))
    count = np.zeros(len(bounds) - 1, np.int64)
    columns = [*np.ascontiguousarray(table.T)]
    end = int(bounds[-1])
    for a in range(int(bounds[0]), end, PIECE):
        b = min(a + PIECE, end)
        far = min(b + SIZES[-1], end)
        rows = [r[: b - a] for r in _rows(buf[a:far], _inside(bounds, a, far))]
        starts = np.unique(np.concatenate(([a], bounds[(bounds > a) & (bounds < b)]))) - a
        text = np.searchsorted(bounds, starts + a, "right") - 1
        for k, column in enumerate(columns):
            values = column[rows[0]]
            for r in rows[1:]:
                values += column[r]
            total[text, k] += np.add.reduceat(values, starts)
        some = sum((r < ROWS).view(np.uint8) for r in rows)
        count[text] += np.add.reduceat(some, starts, dtype=np.int64)
    return total, count


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 1.0

    def probabilities(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities of each text, and its number of n-grams."""
        total, count = sums(buf, bounds, self.table)
        return _softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature), count


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _pieces(text: str, rng: np.random.Generator) -> list[bytes]:
    words = text.split()
    cuts = np.cumsum(rng.integers(4, 61, len(words) // 4 + 1))
    cuts = [0, *cuts[cuts < len(words)].tolist(), len(words)]
    return [" ".join(words[a:b]).lower().encode() for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def _joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)


def train(samples: list[tuple[str, str]], epochs: int = 2, rate: float = 0.3, batch: int = 256, most_errors: float = 0.01, floor: float | None = None, seed: int = 5) -> Model:
    """From (language, text). Every fifth text is held out for the temperature and the accepted probability."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return Model([""], np.zeros((ROWS + 1, 1), np.float32), np.zeros(1), 1.0, 2.0)
    rng = np.random.default_rng(seed)
    of = {lang: k for k, lang in enumerate(languages)}
    sets: tuple[list, list] = ([], [])
    for k, (lang, text) in enumerate(samples):
        if k % 5 == 4:
            sets[1].append((text.lower().encode(), of[lang]))
        else:
            sets[0].extend((p, of[lang]) for p in _pieces(text, rng))
    c = len(languages)
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (ROWS + 1, WIDTH)).astype(np.float32)
    embed[ROWS] = 0
    layer = (rng.standard_normal((WIDTH, c)) / np.sqrt(WIDTH)).astype(np.float32)
    bias = np.zeros(c, np.float32)
    seen_e, seen_w, seen_b = np.full(ROWS + 1, 1e-8, np.float32), np.full_like(layer, 1e-8), np.full(c, 1e-8, np.float32)
    fit, held = sets
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for s in range(0, len(order), batch):
            mine = [fit[k] for k in order[s : s + batch]]
            buf, ends = _joined([p for p, _ in mine])
            rows = np.stack(_rows(buf, _inside(ends, 0, len(buf))), 1).ravel()
            who = np.repeat(np.repeat(np.arange(len(mine)), np.diff(ends)), len(SIZES))
            ok = rows < ROWS
            rows, who = rows[ok], who[ok]
            n = np.maximum(np.bincount(who, minlength=len(mine)), 1).astype(np.float32)
            gather = embed[rows]
            mean = np.stack([np.bincount(who, gather[:, k], len(mine)) for k in range(WIDTH)], 1).astype(np.float32) / n[:, None]
            p = _softmax(mean @ layer + bias)
            p[np.arange(len(mine)), [y for _, y in mine]] -= 1
            p /= len(mine)
            g_mean = (p @ layer.T / n[:, None]).astype(np.float32)
            g_layer, g_bias = mean.T @ p, p.sum(0)
            g_embed = np.stack([np.bincount(rows, g_mean[who, k], ROWS + 1) for k in range(WIDTH)], 1).astype(np.float32)
            seen_e += (g_embed**2).mean(1)
            seen_w += g_layer**2
            seen_b += g_bias**2
            embed -= rate * g_embed / np.sqrt(seen_e)[:, None]
            layer -= rate * g_layer / np.sqrt(seen_w)
            bias -= rate * g_bias / np.sqrt(seen_b)
    table = (embed @ layer).astype(np.float32)
    table[ROWS] = 0
    model = Model(languages, table, bias.astype(np.float64))
    calibrate(model, held or fit, most_errors, 1.2 / c if floor is None else floor)
    return model


def calibrate(model: Model, held: list[tuple[bytes, int]], most_errors: float, floor: float) -> None:
    """Sets the temperature with the best log-likelihood and the least accepted probability."""
    total, count = sums(*_joined([p for p, _ in held]), model.table)
    z = total / np.maximum(count, 1)[:, None] + model.bias
    y = np.array([k for _, k in held])
    grid = np.geomspace(0.05, 20, 60)
    # smoothed targets: so few texts without an error don't prove that there are none
    target = np.full(z.shape, 1 / (len(y) + 2) / max(1, z.shape[1] - 1))
    target[np.arange(len(y)), y] = 1 - 1 / (len(y) + 2)
    loss = [-(target * np.log(_softmax(z / t) + 1e-12)).sum(1).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / model.temperature)
    top = p.max(1)
    order = np.argsort(-top)
    errors = np.cumsum(p.argmax(1)[order] != y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(errors <= most_errors)
    model.least = max(floor, float(top[order][good[-1]]) if len(good) else 1.0)
    if len(good) == len(y):
        model.least = floor


def fit(docs: DataFrame, most_docs: int = 1000, **options) -> Model:
    """Trains on labelled rows, at most about most_docs of them; all rows where there are fewer."""
    labelled = docs.select("doc_id", "lang", "text").where("lang IS NOT NULL AND length(text) > 0")
    n = docs.select("lang").where("lang IS NOT NULL").count()
    if n > most_docs:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 30)) < int((1 << 30) * most_docs / n))
    rows = labelled.select("lang", "text", "doc_id").limit(2 * most_docs).collect()
    return train([(r.lang, r.text) for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text))], **options)


def _scored(model: Model, buf: np.ndarray, bounds: np.ndarray):
    p, count = model.probabilities(buf, bounds)
    best = p.argmax(1)
    top = np.where(count > 0, p[np.arange(len(p)), best], 0.0)
    return best, top, count, (count > 0) & (top >= model.least)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Language, calibrated probability and acceptance of each row. Narrow: nothing is shuffled."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names = np.array([*sent.value.languages, None], object)
        for part, buf, bounds in _text.slices(batches):
            best, top, count, ok = _scored(sent.value, buf, bounds)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[np.where(count > 0, best, -1)], pa.string()), pa.array(top), pa.array(ok)], ["doc_id", "language", "probability", "accepted"])

    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, IDENTIFIED)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are accepted, with all their columns."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, buf, bounds in _text.slices(batches, None):
            yield _text.kept(part, _scored(sent.value, buf, bounds)[3])

    return _text.with_lower(docs).mapInArrow(run, docs.schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
