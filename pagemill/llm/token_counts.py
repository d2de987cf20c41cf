"""Token counts by a linear longest-match automaton.

A trie of the vocabulary gets failure links: a node's link is where matching goes on after the greedy longest pieces of
the node's string have been taken, and the number of pieces so taken is stored beside it. Reading a word needs one step
or link for each byte, and only the stored numbers are added up; no piece is built. A byte-level vocabulary is matched
anywhere; one with a continuation mark (such as ##) is matched from the mark's node after the first piece.

A text is cut before every space, so that a piece may begin with one space, as byte-level vocabularies have it; all its
bytes are counted. Counts of words are remembered in a table of bounded size that each worker fills on its way.

Defined results: a null text has a null count and an empty one 0; a word that no pieces make up counts as one piece
(with a byte-level vocabulary there is none); each repeated row is counted; a null doc_id stays; other columns are
ignored.
"""

from __future__ import annotations

import importlib.util
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shared import ship

REMEMBER = 1 << 18
TOKENIZERS = "/opt/tokenizers"


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def byte_level_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file without its special ones."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))
    special = {x["content"] for x in model.get("added_tokens", [])}
    letters = byte_alphabet()
    return [bytes(letters[c] for c in piece) for piece in model["model"]["vocab"] if piece not in special and all(c in letters for c in piece)]


class Automaton:
    """Greedy longest-match piece counts in one pass over the bytes."""

    def __init__(self, pieces: list[bytes], mark: bytes = b""):
        step: list[dict[int, int]] = [{}]
        final = [False]
        for piece in [mark, *pieces] if mark else pieces:
            at = 0
            for c in piece:
                to = step[at].get(c)
                if to is None:
                    to = step[at][c] = len(step)
                    step.append({})
                    final.append(False)
                at = to
            final[at] = final[at] or (piece != mark and bool(piece))
        start = 0
        for c in mark:
            start = step[start][c]
        link, taken = [-1] * len(step), [0] * len(step)
        queue = [(0, -1, 0)] + ([(start, -1, 0)] if mark else [])
        roots = {0, start}
        k = 0
        order = []
        while k < len(queue):
            node, parent, c = queue[k]
            k += 1
            order.append((node, parent, c))
            queue += [(to, node, b) for b, to in step[node].items() if to not in roots]
        for node, parent, c in order:
            if node in roots:
                continue
            if final[node]:
                link[node], taken[node] = start, 1
                continue
            z, n = link[parent], taken[parent]
            while z >= 0 and c not in step[z]:
                n += taken[z]
                z = link[z]
            if z >= 0:
                link[node], taken[node] = step[z][c], n
        self.step, self.link, self.taken, self.start = step, link, taken, start

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 where there is no way to make it up."""
        step, link, taken = self.step, self.link, self.taken
        at = n = 0
        for c in word:
            to = step[at].get(c)
            while to is None:
                z = link[at]
                if z < 0:
                    return 1
                n += taken[at]
                at = z
                to = step[at].get(c)
            at = to
        while at != self.start and at:
            if link[at] < 0:
                return 1
            n += taken[at]
            at = link[at]
        return n


class _Memory(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        n = self[word] = self.automaton.count(word.encode())
        return n


_MADE: dict[tuple, _Memory] = {}


def _counter(key: tuple, pieces: list[bytes], mark: bytes) -> _Memory:
    if key not in _MADE:
        _MADE[key] = _Memory(Automaton(pieces, mark))
    return _MADE[key]


def count_text(memory, text: str) -> int:
    first, *rest = text.split(" ")
    return (memory[first] if first else 0) + sum(map(memory.__getitem__, map(" ".__add__, rest)))


def token_counts(docs: DataFrame, pieces: list[bytes], mark: bytes = b"") -> DataFrame:
    """doc_id and n_tokens of each row. Narrow: nothing is shuffled; the vocabulary, of fixed size, is broadcast."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((pieces, mark))
    key = (hash(tuple(pieces)), mark)

    def run(batches):
        memory = _counter(key, *sent.value)
        for batch in batches:
            texts = batch.column("text")
            counts = [None if not t.is_valid else count_text(memory, t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def op5_token_counts(spark, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_level_pieces(vocabulary))
