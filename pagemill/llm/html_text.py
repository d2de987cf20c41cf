"""HTML extraction with host suffix arrays.

Markup, scripts, styles, comments and hidden elements (templates, vector images, frames) that are closed go; of one that
closes itself or is never closed only the tag goes, and names such as svg-icon are no hidden elements. What is left is cut at white space. The token streams of all pages of a host are
put one behind the other, a different end mark after each, and a suffix array is built by prefix doubling as deep as
`least` tokens: suffixes of one rank then share their first `least` tokens. Runs of that length that distinct pages of a
host have in common are boilerplate; every token that such a run covers goes, and the other runs are kept, one a line.

A host's pages meet in one task as long as their HTML has at most `host_limit` bytes. Beyond it, the runs themselves are
shuffled by hash and only the covered places come back to the pages, with the same result.

Defined results: a null page_id is a page of its own; null html gives null text, empty or wholly common html gives '';
pages without a host in their url are compared with none; rows with the same page_id are one page (they aren't
boilerplate of one another) and are returned each; a page shorter than `least` tokens is kept whole; two pages of a host
with equal text have all of it in common and both end up empty; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import ship
from . import _text
from ._work import Scratch

LEAST, HOST_LIMIT = 8, 160 << 20
_GONE = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)(noscript|template|iframe|svg)(?=[\s/>])(?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*>|<[a-z/!?][^>]*(?:>|\Z)")
_HIDDEN = re.compile(r"(?i)<(?:noscript|template|iframe|svg)[\s/>]")
TEXTS, CLEAN = "host string, page_id bigint, text string", "page_id bigint, host string, text string, n_tokens bigint, n_kept bigint"


def visible(html: str) -> str:
    """The text of a page without markup and with entities resolved."""
    return entities.unescape(_GONE.sub(" ", _shown(html) if _HIDDEN.search(html) else html))


def _shown(html: str) -> str:
    """Without hidden elements that are closed; one that closes itself or is never closed is a tag like any other."""
    opened: list[tuple[str, int]] = []
    gone: list[tuple[int, int]] = []
    for m in _GONE.finditer(html):
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            k = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][0] == name), None)
            if k is not None:
                first = opened[k][1]
                del opened[k:]
                while gone and gone[-1][0] > first:  # elements within this one
                    gone.pop()
                gone.append((first, m.end()))
        elif not m[0].endswith("/>"):
            opened.append((name, m.start()))
    out, at = [], 0
    for first, end in gone:
        out += [html[at:first], " "]
        at = end
    return "".join([*out, html[at:]])


def ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """A suffix array as ranks: suffixes get the same rank if their first `depth` tokens agree.

    By prefix doubling: the rank to depth h + g of a suffix follows from its ranks at itself and g further on. The sort
    runs over slices of the old rank, so its working memory is a part of the whole.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    rank = np.empty(n, np.int32)
    rank[order] = _first_of_group(tokens[order])
    del order
    h = 1
    while h < depth:
        g = min(h, depth - h)
        new = rank.copy()
        for low in range(0, n, SORTED):
            at = np.flatnonzero((rank >= low) & (rank < low + SORTED))
            ahead = np.where(at + g < n, rank[np.minimum(at + g, n - 1)], -1)
            key = rank[at].astype(np.int64) * (n + 1) + ahead + 1
            o = np.argsort(key, kind="stable")
            new[at[o]] = low_rank(rank[at[o]], _first_of_group(key[o]))
        rank = new
        h += g
    return rank


SORTED = 1 << 21


def low_rank(old: np.ndarray, first: np.ndarray) -> np.ndarray:
    """New ranks within the range of the old ones: an old rank is the place of its group's first suffix in the order."""
    starts = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1]))) if len(old) else np.empty(0, np.int64)
    lengths = np.diff(np.append(starts, len(old)))
    return (old + first - np.repeat(starts, lengths)).astype(np.int32)


def _first_of_group(sorted_keys: np.ndarray) -> np.ndarray:
    """For each element of a sorted array the place of the first equal one."""
    if not len(sorted_keys):
        return np.empty(0, np.int32)
    starts = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return np.repeat(starts, np.diff(np.append(starts, len(sorted_keys)))).astype(np.int32)


def covered(tokens: np.ndarray, page: np.ndarray, least: int) -> np.ndarray:
    """Which tokens lie in a run of `least` tokens that distinct pages share; pages end in marks that occur once."""
    rank = ranks(tokens, least)
    n = len(tokens)
    low, high = np.full(n, np.iinfo(np.int32).max, np.int32), np.full(n, -1, np.int32)
    np.minimum.at(low, rank, page)
    np.maximum.at(high, rank, page)
    common = (low < high)[rank]
    marks = np.zeros(n + least + 1, np.int32)
    starts = np.flatnonzero(common)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + least, -1)
    return np.cumsum(marks)[:n] > 0


def _kept_text(buf: np.ndarray, s: np.ndarray, e: np.ndarray, keep: np.ndarray) -> bytes:
    """The kept runs, a line each, as they stand in the text."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8)))
    return b"\n".join(buf[s[a] : e[b - 1]].tobytes() for a, b in zip(edge[::2], edge[1::2]))


def _marked(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token streams with an end mark of its own after each text, and the places of the tokens among them."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(h)) + text
    out = np.empty(len(h) + len(offsets) - 1, np.uint64)
    out[at] = h | np.uint64(1)
    ends = offsets[1:] + np.arange(len(offsets) - 1)
    out[ends] = np.arange(len(ends), dtype=np.uint64) << np.uint64(1)
    return out, at


def _host(least: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, host = table.column("page_id"), table.column("host")[0].as_py()
        column = table.column("text").chunk(0) if table.column("text").num_chunks else pa.array([], pa.string())
        buf, bounds = _text.utf8(column)
        h, s, e, offsets = _text.words(buf, bounds, _text.NOT_BLANK)
        stream, at = _marked(h, offsets)
        del h
        # rows of one page_id are one page; a null one stands alone
        page = np.arange(len(ids), dtype=np.int32)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        page[known] = len(ids) + np.unique(ids.drop_null().to_numpy(), return_inverse=True)[1]
        of = np.repeat(page, np.diff(offsets) + 1)
        keep = ~covered(stream, of, least)[at]
        texts = [_kept_text(buf, s[a:b], e[a:b], keep[a:b]).decode() if v else None for a, b, v in zip(offsets[:-1], offsets[1:], column.is_valid().to_pylist())]
        kept = np.concatenate(([0], np.cumsum(keep)))
        shown = None if host.startswith("\t") else host
        return pa.table({"page_id": ids, "host": pa.array([shown] * len(texts), pa.string()), "text": pa.array(texts, pa.string()), "n_tokens": np.diff(offsets), "n_kept": kept[offsets[1:]] - kept[offsets[:-1]]})

    return run


def _visible_batches(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page_id"), pa.array([None if x is None else visible(x) for x in batch.column("html").to_pylist()], pa.string())], ["host", "page_id", "text"])


def _runs(least: int):
    """Each row's runs of `least` tokens as (host, page, row, place, 128-bit hash)."""

    def run(batches):
        for part, buf, bounds in _text.slices(batches):
            h, _, _, offsets = _text.words(buf, bounds, _text.NOT_BLANK)
            n = np.maximum(np.diff(offsets) - least + 1, 0)
            row = np.repeat(np.arange(part.num_rows), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = offsets[:-1][row] + place
            a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
            for k in range(least):
                a = a * np.uint64(0xD1342543DE82EF95) + h[at + k]
                b = b * np.uint64(0x9FB21C651E98DF25) + _text.mix(h[at + k])
            keys, take = part.select(["host", "page", "row"]), pa.array(row)
            for x in range(0, len(row), 1 << 18):
                y = slice(x, x + (1 << 18))
                own = keys.take(take[y])
                yield pa.RecordBatch.from_arrays([own.column("host"), own.column("page"), own.column("row"), pa.array(place[y].astype(np.int32)), pa.array(_text.mix(a[y]).view(np.int64)), pa.array(_text.mix(b[y]).view(np.int64))], ["host", "page", "row", "place", "h1", "h2"])

    return run


def _without(least: int):
    def run(batches):
        for part, buf, bounds in _text.slices(batches):
            h, s, e, offsets = _text.words(buf, bounds, _text.NOT_BLANK)
            texts, kept = [], []
            for k, places in enumerate(part.column("places").to_pylist()):
                keep = np.ones(offsets[k + 1] - offsets[k], bool)
                for p in places or []:
                    keep[p : p + least] = False
                own = slice(offsets[k], offsets[k + 1])
                texts.append(_kept_text(buf, s[own], e[own], keep).decode() if part.column("text")[k].is_valid else None)
                kept.append(int(keep.sum()))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("host"), pa.array(texts, pa.string()), pa.array(np.diff(offsets)), pa.array(kept, pa.int64())], ["page_id", "host", "text", "n_tokens", "n_kept"])

    return run


def extract(pages: DataFrame, least: int = LEAST, host_limit: int = HOST_LIMIT) -> DataFrame:
    """Each page's own text. Texts are shuffled once, by host."""
    ship(pages.sparkSession)
    name = F.regexp_extract(F.lower("url"), r"^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.when(F.length(name) > 0, name).otherwise(F.concat(F.lit("\t"), F.coalesce(F.col("page_id").cast("string"), F.uuid())))
    rows = pages.select("page_id", host.alias("host"), "html")
    # only hosts above the limit, few as they are, come to the driver; pages without a host are none
    large = [r.host for r in pages.select(name.alias("host"), F.octet_length("html").alias("size")).where("host <> ''").groupBy("host").agg(F.sum("size").alias("size")).where(F.col("size") > host_limit).toLocalIterator()]
    small = rows.where(~F.col("host").isin(large)) if large else rows
    out = small.mapInArrow(_visible_batches, TEXTS).groupBy("host").applyInArrow(_host(least), CLEAN)
    if large:
        texts = rows.where(F.col("host").isin(large)).mapInArrow(_visible_batches, TEXTS)
        # written once, so that rows keep the keys they get here: a null page_id is a page of its own
        texts = texts.withColumn("row", F.expr("uuid()")).withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("\t"), "row")))
        texts = Scratch(pages.sparkSession, "html-texts").keep(texts, "large")
        runs = texts.mapInArrow(_runs(least), "host string, page string, row string, place int, h1 bigint, h2 bigint")
        common = runs.groupBy("host", "h1", "h2").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a < b").drop("a", "b")
        places = runs.join(common, ["host", "h1", "h2"], "left_semi").groupBy("host", "page", "row").agg(F.collect_set("place").alias("places"))
        out = out.unionByName(texts.join(places, ["host", "page", "row"], "left").select("page_id", "host", "text", "places").mapInArrow(_without(least), CLEAN))
    return out


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
