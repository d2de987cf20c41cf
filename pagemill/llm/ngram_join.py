"""N-gram Jaccard self-join by vertical partitioning.

The global order of word n-grams (their hashes) is cut into fragments, and every fragment is worked on alone; a
document's, and a pair's, figures are sums over fragments. The join has three steps:

1. Each fragment finds which of its n-grams two documents or more have. A document of whose n-grams fewer than
   ceil(t |x|) are shared has no partner and goes (what is shared within a slice of the table is counted there and sent
   once); of documents with the same words in the same order the least doc_id
   stands for all, as their class.
2. Over the classes' first documents alone, each fragment counts how many have each n-gram and names the n-gram's head,
   the least of them. By the prefix filter, two documents with similarity t or more have an n-gram in common that for
   both is among the |x| - ceil(t |x|) + 1 that fewest have (all ties at that place included). So they meet in the cell
   of its head: a cell holds the documents that have that head among the heads of their prefix.
3. The n-grams of the documents of a cell come together, and cells of many documents or n-grams are cut into blocks, of
   which each two meet. The common n-grams are counted for each fragment of the order (a matrix product where many have
   them, runs where few do) and summed per pair. A pair that meets in several cells counts in that of the least head.

So no pair crosses a shuffle, none is collected, and no table of documents is sent but below a checked size. Steps 1 and
2 tell n-grams apart by fragment and 32 more bits, which can only let more documents pass (sizes that fell short are
allowed for by a slack); step 3 uses whole 64-bit hashes.

Defined results: a null doc_id (and -2^63, which stands for nobody) takes part in no pair; null and empty texts and texts without words have no n-grams and
no pairs; rows with the same doc_id are one document with the n-grams of all of them; documents with fewer than n words
have one shorter n-gram; ties need no rule, since all pairs count; very long texts are documents like any other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._work import SEND_LIMIT, Scratch, fragments

ENTRIES = "frag int, doc binary, far binary, gram binary, words binary"
FIGURES = "part int, doc binary, far binary, key binary, head binary, place binary, size binary, words binary"
CELL_ROWS = "grp bigint, head bigint, low int, high int, side int, doc_id bigint, copies bigint, heads binary, grams binary"
LINKS = "doc_id bigint, links bigint, root bigint"
PAIRS = "doc_a bigint, doc_b bigint, overlap bigint, jaccard double"
#: Rows of one slice (14 bits of a key), n-grams of one fragment, and the most documents and n-grams of one block of a cell.
ROWS, FRAGMENT, BLOCK_DOCS, BLOCK_GRAMS = 1 << 14, 3 << 19, 2048, 1 << 21
#: Cells of up to so many documents are counted side by side; columns of one matrix product.
SMALL, COLUMNS = 64, 2048
_LOW, NOBODY = np.uint64(0xFFFFFFFF), np.iinfo(np.int64).min


def _first(x: np.ndarray) -> np.ndarray:
    """Which elements of a sorted array differ from the one before."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


def _steps(ids: np.ndarray, kind) -> tuple[bytes, bytes]:
    """Ascending ids as short steps; the kind's greatest value stands for the next of the far ones."""
    step, most = np.diff(ids.view(np.uint64), prepend=np.uint64(0)), np.uint64(np.iinfo(kind).max)
    far = step >= most
    return np.where(far, most, step).astype(kind).tobytes(), step[far].tobytes()


def _ids(step, far, kind) -> np.ndarray:
    x = np.frombuffer(step or b"", kind).astype(np.uint64)
    x[x == np.iinfo(kind).max] = np.frombuffer(far or b"", np.uint64)
    return np.cumsum(x, dtype=np.uint64).view(np.int64)


def _blob(x) -> bytes:
    return x.as_py() or b""


def _arrays(column, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(_blob(x), kind) for x in column)])


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [(x.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, names)], [n for n, _ in names])


def _order_of(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each text's sequence of words."""
    n = np.diff(offsets)
    at = np.arange(len(h)) - np.repeat(offsets[:-1], n)
    up, down = _text.powers(int(n.max(initial=0)) + 1)
    out = np.empty((len(n), 2), np.uint64)
    for k, x in enumerate((h * up[at], (h ^ (h >> np.uint64(29))) * down[at])):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        out[:, k] = _text.mix(sums[offsets[1:]] - sums[offsets[:-1]] + n.astype(np.uint64))
    return out


def _slack(size: np.ndarray) -> np.ndarray:
    """More n-grams than a document's can have fallen together with others of its own."""
    return 2 + (size.astype(np.float64) ** 2 / 2**32).astype(np.int64)


def _entries(n: int, count: int, parts: int, merged: bool):
    """For each slice and fragment the documents' n-grams, by document; behind the fragments, for each part, sizes and word orders.

    merged: an n-gram that several documents of the slice have is known to be shared. It is counted for them here and
    sent once, in nobody's name, so that one which a large part of all documents has is sent once a slice.
    """

    def sent(part: pa.RecordBatch, buf: np.ndarray, bounds: np.ndarray):
        h, _, _, offsets = _text.words(buf, bounds)
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        by = np.argsort(ids, kind="stable")
        ids = ids[by]
        rank = np.empty(len(by), np.uint64)
        rank[by] = np.arange(len(by), dtype=np.uint64)
        g, at = _text.grams(h, offsets, n)
        key = (((g >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32) << np.uint64(14) | np.repeat(rank, np.diff(at))) << np.uint64(32) | g & _LOW
        key.sort()
        key = key[_first(key)]
        row = ((key >> np.uint64(32)) & np.uint64(ROWS - 1)).astype(np.int64)
        size, here = np.bincount(row, minlength=len(ids)), np.zeros(len(ids), np.int64)
        who, gram = ids[row], (key & _LOW).astype(np.uint32)
        if merged:
            turned = np.sort(key >> np.uint64(46) << np.uint64(46) | (key & _LOW) << np.uint64(14) | key >> np.uint64(32) & np.uint64(ROWS - 1))
            name = turned >> np.uint64(14)
            again = ~_first(name)
            several = again.copy()
            several[:-1] |= again[1:]
            here = np.bincount((turned[several] & np.uint64(ROWS - 1)).astype(np.int64), minlength=len(ids))
            once = turned[~several]
            own = np.sort(once >> np.uint64(46) << np.uint64(46) | (once & np.uint64(ROWS - 1)) << np.uint64(32) | once >> np.uint64(14) & _LOW)
            nobody = name[several & ~again]
            frag = np.concatenate((nobody >> np.uint64(32), own >> np.uint64(46)))
            who = np.concatenate((np.full(len(nobody), NOBODY), ids[(own >> np.uint64(32) & np.uint64(ROWS - 1)).astype(np.int64)]))
            gram = np.concatenate((nobody & _LOW, own & _LOW)).astype(np.uint32)
            order = np.argsort(frag, kind="stable")
            who, gram, key = who[order], gram[order], frag[order] << np.uint64(46)
        edge = np.searchsorted(key, np.arange(count + 1, dtype=np.uint64) << np.uint64(46))
        rows = [(f, *_steps(who[a:b], np.uint8), gram[a:b].tobytes(), None) for f, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]
        words = _order_of(h, offsets)[by]
        some = np.flatnonzero(size)
        to = _part(ids[some], parts)
        by = np.argsort(to, kind="stable")
        some, to = some[by], to[by]
        edge = np.searchsorted(to, np.arange(parts + 1))
        rows += [(count + p, ids[s].tobytes(), here[s].astype(np.uint32).tobytes(), size[s].astype(np.uint32).tobytes(), words[s].tobytes()) for p, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a for s in [some[a:b]]]
        if rows:
            yield _record(rows, ENTRIES)

    def run(batches):
        for part, buf, bounds in _text.slices(batches):
            for a in range(0, part.num_rows, ROWS):
                yield from sent(part.slice(a, ROWS), buf, bounds[a : a + ROWS + 1])

    return run


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return (_text.mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _passed_on(table: pa.Table, part: int) -> pa.Table:
    rows = [(part, doc.as_py(), here.as_py(), None, None, None, size.as_py(), words.as_py()) for doc, here, size, words in zip(*(table.column(k) for k in ("doc", "far", "gram", "words")))]
    return pa.Table.from_batches([_record(rows, FIGURES)])


def _of_fragment(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A fragment's entries: whose they are, the order by n-gram, and first place and number of each n-gram in it."""
    who = np.concatenate([_ids(d.as_py(), f.as_py(), np.uint8) for d, f in zip(table.column("doc"), table.column("far"))])
    key = _arrays(table.column("gram"), np.uint32).astype(np.uint64) << np.uint64(32) | np.arange(len(who), dtype=np.uint64)
    key.sort()
    first = np.flatnonzero(_first(key >> np.uint64(32)))
    return who, key, first, np.diff(np.append(first, len(key)))


def _by_part(who: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    to = _part(who, parts)
    order = np.lexsort((who, to))
    return order, np.searchsorted(to[order], np.arange(parts + 1))


def _shared(count: int, parts: int):
    """One fragment: how many of each document's n-grams another has too."""

    def run(table: pa.Table) -> pa.Table:
        frag = table.column("frag")[0].as_py()
        if frag >= count:
            return _passed_on(table, frag - count)
        who, key, _, df = _of_fragment(table)
        mark = np.empty(len(who), bool)
        mark[(key & _LOW).astype(np.int64)] = np.repeat(df > 1, df)
        start = np.flatnonzero(_first(who))
        own, n = who[start], np.add.reduceat(mark, start, dtype=np.int64)
        keep = (n > 0) & (own != NOBODY)
        own, n = own[keep], n[keep]
        order, edge = _by_part(own, parts)
        own, n = own[order], n[order].astype(np.uint32)
        rows = [(p, *_steps(own[a:b], np.uint16), n[a:b].tobytes(), None, None, None, None) for p, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]
        return pa.Table.from_batches([_record(rows, FIGURES)])

    return run


def _headed(count: int, parts: int):
    """One fragment: for each document's shared n-grams how many have them, and who is the first."""

    def run(table: pa.Table) -> pa.Table:
        frag = table.column("frag")[0].as_py()
        if frag >= count:
            return _passed_on(table, frag - count)
        who, key, first, df = _of_fragment(table)
        who = who[(key & _LOW).astype(np.int64)]
        many = np.repeat(df > 1, df)
        head = np.repeat(np.minimum.reduceat(who, first), df)[many]
        # rare ones first; of those that equally many have, by a byte of the n-gram
        place = (np.repeat(np.minimum(df, (1 << 24) - 1).astype(np.uint32), df) << np.uint32(8) | (key >> np.uint64(32)).astype(np.uint32) & np.uint32(255))[many]
        who = who[many]
        order, edge = _by_part(who, parts)
        who, head, place = who[order], head[order], place[order]
        rows = []
        for p, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
            if b > a:
                heads, at = np.unique(head[a:b], return_inverse=True)
                step, far = _steps(heads, np.uint16)
                at = at.astype(np.uint16 if len(heads) < 1 << 16 else np.uint32)
                rows.append((p, *_steps(who[a:b], np.uint16), place[a:b].tobytes(), len(step).to_bytes(4, "little") + step + far, at.tobytes(), None, None))
        return pa.Table.from_batches([_record(rows, FIGURES)])

    return run


def _figures(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Documents with the sums of their rows' sizes and n-grams shared within slices, the number of rows, and word orders (of those with one row); then the other entries and their documents."""
    known = np.array([s.is_valid for s in table.column("size")], bool)
    own = table.filter(pa.array(known))
    docs, at, rows = np.unique(_arrays(own.column("doc"), np.int64), return_inverse=True, return_counts=True)
    size = np.bincount(at, _arrays(own.column("size"), np.uint32), len(docs)).astype(np.int64)
    here = np.bincount(at, _arrays(own.column("far"), np.uint32), len(docs)).astype(np.int64)
    words = np.zeros((len(docs), 2), np.uint64)
    words[at] = _arrays(own.column("words"), np.uint64).reshape(-1, 2)
    rest = table.filter(pa.array(~known))
    who = np.concatenate([np.empty(0, np.int64), *(_ids(d.as_py(), f.as_py(), np.uint16) for d, f in zip(rest.column("doc"), rest.column("far")))])
    return docs, size, here, rows, words, rest, np.searchsorted(docs, who)


def _survivors(t: float):
    """Documents that have enough shared n-grams for a partner."""

    def run(table: pa.Table) -> pa.Table:
        docs, size, here, rows, words, rest, at = _figures(table)
        shared = here + np.bincount(at, _arrays(rest.column("key"), np.uint32), len(docs))
        keep = (shared > 0) & (shared + _slack(size) >= np.ceil(t * size - 1e-9))
        return pa.table({"doc_id": docs[keep], "size": size[keep], "n_rows": rows[keep], "w1": words[keep, 0].view(np.int64), "w2": words[keep, 1].view(np.int64)})

    return run


def _memberships(t: float):
    """The cells of each document: the heads of the n-grams in its prefix."""

    def run(table: pa.Table) -> pa.Table:
        docs, size, _, rows, _, rest, at = _figures(table)
        key, heads = _arrays(rest.column("key"), np.uint32), [np.empty(0, np.int64)]
        for head, place in zip(rest.column("head"), rest.column("place")):
            raw = _blob(head)
            k = 4 + int.from_bytes(raw[:4], "little")
            names = _ids(raw[4:k], raw[k:], np.uint16)
            heads.append(names[np.frombuffer(_blob(place), np.uint16 if len(names) < 1 << 16 else np.uint32)])
        head = np.concatenate(heads)
        shared = np.bincount(at, minlength=len(docs))
        prefix = np.minimum(shared, shared - np.ceil(t * size - 1e-9).astype(np.int64) + 1 + _slack(size))
        prefix = np.where(rows > 1, shared, prefix)  # of several rows the union's size isn't known here
        order = np.lexsort((key, at))
        at, key, head = at[order], key[order], head[order]
        some = prefix > 0
        cut = np.full(len(docs), -1, np.int64)
        cut[some] = key[(np.cumsum(shared) - shared + prefix - 1)[some]]
        keep = key <= cut[at]
        at, head = at[keep], head[keep]
        order = np.lexsort((head, at))
        at, head = at[order], head[order]
        keep = _first(at) | _first(head)
        return pa.table({"doc_id": docs[at[keep]], "head": head[keep], "size": size[at[keep]]})

    return run


def _cell_rows(n: int, packs: int):
    """A document's n-grams once for each of its cells, and in a large cell for each two blocks that its own is one of."""

    def run(batches):
        rows, held = [], 0
        for part, buf, bounds in _text.slices(batches):
            h, _, _, offsets = _text.words(buf, bounds)
            g, at = _text.grams(h, offsets, n)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            mixed = _text.mix(ids.view(np.uint64))
            for i, (copies, heads, blocks) in enumerate(zip(*(part.column(k).to_pylist() for k in ("copies", "heads", "blocks")))):
                grams, all_heads = np.unique(g[at[i] : at[i + 1]]).tobytes(), np.array(heads, np.int64).tobytes()
                for head, b in zip(heads, blocks):
                    own = int(mixed[i]) % b
                    for other in range(b):
                        low, high = min(own, other), max(own, other)
                        code = int(_text.mix(np.array([head], np.int64).view(np.uint64) + np.uint64((low << 20) + high))[0])
                        grp = code % packs if b == 1 else code >> 2 | 1 << 62
                        rows.append((grp, head, low, high, int(own == high and low < high), int(ids[i]), copies, all_heads, grams))
                        held += len(grams)
                        if held > 4 << 20:
                            yield _record(rows, CELL_ROWS)
                            rows, held = [], 0
        if rows:
            yield _record(rows, CELL_ROWS)

    return run


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that the edges (a, b) join it to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    return label


class _Cells:
    """The documents of some cells and their n-grams, in the order of cells, n-grams and documents."""

    def __init__(self, table: pa.Table, t: float):
        get = lambda k: table.column(k).to_numpy()
        where = np.stack([get(k).astype(np.int64) for k in ("head", "low", "high")])
        order = np.lexsort((get("doc_id"), *where[::-1]))
        where, doc = where[:, order], get("doc_id")[order]
        new_cell = np.ones(len(doc), bool)
        new_cell[1:] = (where[:, 1:] != where[:, :-1]).any(0)
        new = new_cell | _first(doc)
        row_cell, row_slot = np.cumsum(new_cell) - 1, np.cumsum(new) - 1
        self.t, self.doc, self.cell, self.head = t, doc[new], row_cell[new], where[0][new]
        self.side, self.copies = get("side")[order][new], get("copies")[order][new]
        self.crossing = (where[1] < where[2])[new_cell]  # of two blocks, each of whose own pairs count elsewhere
        self.heads = [np.frombuffer(_blob(table.column("heads")[int(i)]), np.int64) for i in order[new]]
        column = table.column("grams")
        sets = [np.frombuffer(_blob(column[int(i)]), np.uint64) for i in order]
        slot, gram = np.repeat(row_slot, [len(s) for s in sets]), np.concatenate([np.empty(0, np.uint64), *sets])
        if not new.all():  # a document of several rows has the n-grams of all
            order = np.lexsort((gram, slot))
            slot, gram = slot[order], gram[order]
            keep = _first(slot) | _first(gram)
            slot, gram = slot[keep], gram[keep]
        self.size = np.bincount(slot, minlength=len(self.doc))
        order = np.lexsort((gram, self.cell[slot]))  # stable, so by document within an n-gram
        self.slot, gram = slot[order], gram[order]
        self.first = np.cumsum(np.bincount(self.cell)) - np.bincount(self.cell) if len(self.doc) else np.empty(0, np.int64)
        start = np.flatnonzero(_first(self.cell[self.slot]) | _first(gram))
        n = np.diff(np.append(start, len(gram)))
        self.start, self.n = start[n > 1], n[n > 1]
        self.run_cell = self.cell[self.slot[self.start]]

    def pairs(self):
        """(slots a, slots b, overlaps) of all pairs that count here, in parts."""
        docs = np.bincount(self.cell)
        small = np.flatnonzero(docs <= SMALL)
        if len(small):
            yield self._side_by_side(small, docs)
        for c in np.flatnonzero(docs > SMALL):
            yield self._alone(int(c), int(docs[c]))

    def _needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(np.ceil(self.t / (1 + self.t) * (self.size[a] + self.size[b]) - 1e-9), 1)

    def _two_of(self, start: np.ndarray, n: np.ndarray):
        """The pairs of each run of documents with an n-gram, by their distance in the run."""
        for d in range(1, int(n.max(initial=1))):
            start, n = start[n > d], n[n > d]
            at = np.repeat(start - np.cumsum(n - d) + n - d, n - d) + np.arange(int((n - d).sum()))
            yield self.slot[at], self.slot[at + d]

    def _side_by_side(self, cells: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        room = np.zeros(len(docs) + 1, np.int64)
        room[cells + 1] = docs[cells] ** 2
        room = np.cumsum(room)
        use = docs[self.run_cell] <= SMALL
        count = np.zeros(room[-1], np.int64)
        for a, b in self._two_of(self.start[use], self.n[use]):
            c = self.cell[a]
            count += np.bincount(room[c] + (a - self.first[c]) * docs[c] + b - self.first[c], minlength=len(count))
        at = np.flatnonzero(count)
        c = np.searchsorted(room, at, "right") - 1
        a, b = (at - room[c]) // docs[c] + self.first[c], (at - room[c]) % docs[c] + self.first[c]
        keep = count[at] >= self._needed(a, b)
        keep &= (self.side[a] != self.side[b]) | ~self.crossing[c]
        a, b, n = a[keep], b[keep], count[at][keep]
        new = np.array([not self._earlier(x, y) for x, y in zip(a.tolist(), b.tolist())], bool)
        return a[new], b[new], n[new]

    def _earlier(self, a: int, b: int) -> bool:
        x, y, head = self.heads[a], self.heads[b], self.head[a]
        return x[0] < head and y[0] < head and bool(set(x[x < head].tolist()) & set(y[y < head].tolist()))

    def _alone(self, c: int, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.arange(self.first[c], self.first[c] + docs)
        crossing = bool(self.crossing[c])
        left, right = (own[self.side[own] == 0], own[self.side[own] == 1]) if crossing else (own, own)
        row, col = np.full(len(self.doc), -1), np.full(len(self.doc), -1)
        row[left], col[right] = np.arange(len(left)), np.arange(len(right))
        count = np.zeros(len(left) * len(right), np.float32)
        use = self.run_cell == c
        start, n = self.start[use], self.n[use]
        few = n <= max(16, docs // 16)
        codes, held = [], 0

        def add():
            np.add(count, np.bincount(np.concatenate(codes), minlength=len(count)), out=count, casting="unsafe")

        for a, b in self._two_of(start[few], n[few]):
            if crossing:
                mixed = self.side[a] != self.side[b]
                a, b = a[mixed], b[mixed]
                a, b = np.where(self.side[a] == 0, a, b), np.where(self.side[a] == 0, b, a)
            codes.append(row[a] * len(right) + col[b])
            held += len(a)
            if held > 1 << 21:
                add()
                codes, held = [], 0
        if codes:
            add()
        count = count.reshape(len(left), len(right))
        start, n = start[~few], n[~few]
        for k in range(0, len(n), COLUMNS):  # one fragment of the order after the other
            s, m = start[k : k + COLUMNS], n[k : k + COLUMNS]
            which = np.repeat(np.arange(len(m)), m)
            who = self.slot[np.repeat(s - np.cumsum(m) + m, m) + np.arange(len(which))]
            count += self._product(row[who], col[who], which, len(left), len(right), len(m))
        keep = count >= self._needed(left[:, None], right[None, :])
        if not crossing:
            keep = np.triu(keep, 1)
        lesser = [x[x < self.head[own[0]]] for x in (self.heads[int(i)] for i in own)]
        heads, at = np.unique(np.concatenate(lesser), return_inverse=True)
        who = np.repeat(own, [len(x) for x in lesser])
        for k in range(0, len(heads), COLUMNS):
            some = (at >= k) & (at < k + COLUMNS)
            keep &= self._product(row[who[some]], col[who[some]], at[some] - k, len(left), len(right), min(COLUMNS, len(heads) - k)) == 0
        x, y = np.nonzero(keep)
        return left[x], right[y], count[x, y].astype(np.int64)

    def _product(self, row: np.ndarray, col: np.ndarray, which: np.ndarray, n: int, m: int, wide: int) -> np.ndarray:
        x, y = np.zeros((n, wide), np.float32), np.zeros((m, wide), np.float32)
        x[row[row >= 0], which[row >= 0]] = 1
        y[col[col >= 0], which[col >= 0]] = 1
        return x @ y.T


def _pair_rows(t: float):
    def run(table: pa.Table) -> pa.Table:
        cells, out = _Cells(table, t), []
        for a, b, n in cells.pairs():
            x, y = cells.doc[a], cells.doc[b]
            out.append(pa.table({"doc_a": np.minimum(x, y), "doc_b": np.maximum(x, y), "overlap": n, "jaccard": n / (cells.size[a] + cells.size[b] - n)}))
        return pa.concat_tables(out)

    return run


def _link_rows(t: float):
    """For each document how many documents its pairs here link it to, and the least document of those they join it to."""

    def run(table: pa.Table) -> pa.Table:
        cells, out = _Cells(table, t), []
        for a, b, _ in cells.pairs():
            docs, at = np.unique(np.concatenate((cells.doc[a], cells.doc[b])), return_inverse=True)
            x, y = at[: len(a)], at[len(a) :]
            links = np.bincount(x, cells.copies[b], len(docs)) + np.bincount(y, cells.copies[a], len(docs))
            out.append(pa.table({"doc_id": docs, "links": links.astype(np.int64), "root": docs[components(len(docs), x, y)]}))
        return pa.concat_tables(out)

    return run


def _sent(df: DataFrame, width: int, send_limit: int) -> DataFrame:
    """To be broadcast if its rows, of `width` bytes, may be; else it is shuffled."""
    return F.broadcast(df) if df.count() * width <= send_limit else df


def _joined(docs: DataFrame, t: float, n: int, send_limit: int, rows, schema: str) -> tuple[DataFrame, DataFrame, Scratch]:
    """Documents that may have partners with the first of their class and its copies; what the cells give."""
    if not 0 < t <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    scratch = Scratch(docs.sparkSession, "ngram-join")
    texts = docs.select("doc_id", F.lower("text").alias("text")).where(f"doc_id IS NOT NULL AND doc_id <> {NOBODY} AND text IS NOT NULL")
    count = fragments(docs, 6 << 20)
    parts = max(4, count // 4)

    def summed(source, count, parts, each, all_of, schema):
        sent = source.mapInArrow(_entries(n, count, parts, each is _shared), ENTRIES).repartition(count, "frag").groupBy("frag").applyInArrow(each(count, parts), FIGURES)
        return sent.repartition(parts, "part").groupBy("part").applyInArrow(all_of(t), schema)

    found = scratch.keep(summed(texts, count, parts, _shared, _survivors, "doc_id bigint, size bigint, n_rows bigint, w1 bigint, w2 bigint"), "survivors")
    classes = found.where("n_rows = 1").groupBy("w1", "w2", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.lit(1).cast("bigint").alias("n_rows")).where("copies > 1")
    members = found.join(classes, ["w1", "w2", "size", "n_rows"], "left")
    members = scratch.keep(members.select("doc_id", "size", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")), "members")
    firsts = members.where("rep = doc_id")
    held = firsts.agg(F.sum("size")).first()[0] or 0
    count = max(4, min(1 << 17, -(-held // FRAGMENT)))
    of_firsts = texts.join(_sent(firsts.select("doc_id", "copies"), 48, send_limit), "doc_id")
    cells = scratch.keep(summed(of_firsts.select("doc_id", "text"), count, count, _headed, _memberships, "doc_id bigint, head bigint, size bigint"), "cells")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("size") / BLOCK_GRAMS)).cast("int")
    wide = scratch.keep(cells.groupBy("head").agg(blocks.alias("blocks"), F.count("*").alias("n"), F.sum("size").alias("grams")).where("n > 1"), "wide")
    packs = max(4, -(-(wide.agg(F.sum("grams")).first()[0] or 0) // FRAGMENT))
    own = cells.join(_sent(wide.select("head", "blocks"), 40, send_limit), "head").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("head", "blocks"))).alias("own"))
    own = scratch.keep(own.selectExpr("doc_id", "own.head AS heads", "own.blocks AS blocks"), "own")
    size = own.agg(F.sum(F.size("heads") * 16 + 64)).first()[0] or 0
    in_cells = of_firsts.join(F.broadcast(own) if size <= send_limit else own, "doc_id").select("doc_id", "text", "copies", "heads", "blocks")
    return members, in_cells.mapInArrow(_cell_rows(n, packs), CELL_ROWS).repartition(packs, "grp").groupBy("grp").applyInArrow(rows(t), schema), scratch


def pairs(docs: DataFrame, t: float = 0.5, n: int = 3, send_limit: int = SEND_LIMIT) -> tuple[DataFrame, DataFrame]:
    """The pairs with similarity t or more between the first documents of classes; and (doc_id, rep) of all that aren't the first."""
    members, found, _ = _joined(docs, t, n, send_limit, _pair_rows, PAIRS)
    return found, members.where("rep <> doc_id").select("doc_id", "rep")


def links(docs: DataFrame, t: float = 0.5, n: int = 3, send_limit: int = SEND_LIMIT) -> DataFrame:
    """One row for each document with a partner: doc_id, class_id, n_links.

    n_links: how many documents have similarity t or more with it, each copy counted; class_id: the least doc_id that a
    chain of such documents joins it to. Documents without a partner have no row.
    """
    members, found, scratch = _joined(docs, t, n, send_limit, _link_rows, LINKS)
    found = scratch.keep(found, "links")
    label = groups(found.selectExpr("root AS doc_a", "doc_id AS doc_b"), send_limit)
    firsts = found.groupBy("doc_id").agg(F.sum("links").alias("links")).join(label, "doc_id").selectExpr("doc_id AS rep", "group_id", "links")
    out = members.join(_sent(scratch.keep(firsts, "firsts"), 48, send_limit), "rep", "left")
    out = out.select("doc_id", F.coalesce("group_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return out.where("n_links > 0")


def groups(edges: DataFrame, send_limit: int = SEND_LIMIT) -> DataFrame:
    """doc_id and the least doc_id that a chain of pairs (doc_a, doc_b) joins it to, for all documents in pairs."""
    spark = edges.sparkSession
    scratch = Scratch(spark, "groups")
    e = scratch.keep(edges.select("doc_a", "doc_b").where("doc_a <> doc_b"), "edges")
    if e.count() * 16 <= send_limit:
        t = e.toArrow()
        ids, inv = np.unique(np.concatenate([t.column(k).to_numpy() for k in ("doc_a", "doc_b")]).astype(np.int64), return_inverse=True)
        a, b = np.split(inv, 2)
        label = components(len(ids), a, b)
        return spark.createDataFrame(pa.table({"doc_id": ids, "group_id": ids[label]}), "doc_id bigint, group_id bigint")
    # stars: every document links to the least of its neighbours until nothing changes
    e = e.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).distinct()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct().checkpoint()
        if small.exceptAll(e).isEmpty() and e.exceptAll(small).isEmpty():
            break
        e = small
    return e.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).unionByName(e.select(F.col("v").alias("doc_id"), F.col("v").alias("group_id"))).distinct()


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '{_text.WORD_PATTERN}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS gram FROM w),
s AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS overlap FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS MATERIALIZED (SELECT doc_a, doc_b FROM o JOIN s x ON x.doc_id = doc_a JOIN s y ON y.doc_id = doc_b WHERE overlap / (x.size + y.size - overlap) >= 0.5),
reach AS (SELECT doc_a AS doc, doc_a AS other FROM p UNION SELECT reach.doc, p.doc_b FROM reach JOIN p ON reach.other = p.doc_a),
c AS (SELECT doc, min(other) AS class_id FROM reach GROUP BY doc)
SELECT doc_a AS doc_id, min(class_id) AS class_id, count(*) AS n_links FROM p JOIN c ON c.doc = doc_a GROUP BY doc_a"""
