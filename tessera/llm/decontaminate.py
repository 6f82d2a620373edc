"""Benchmark decontamination by q-gram filtering in diagonal bands and banded alignment.

Texts are compared in normal form: lower case, runs of anything but letters and digits as one space. A document holds an item of m
characters if some part of it is within e = `rate` * m edits of it. Such a part shares at least T = m - q + 1 - q * e character q-grams with
the item (q-gram lemma), on diagonals (place in the document minus place in the item) that differ by e at most. Diagonals are cut into
overlapping bands of width 2 (e + 1), so that one band has them all; bands with T hits or more are regions, neighbouring ones together. A region is
verified by an alignment restricted to its diagonals; an exact occurrence needs none. Every disjoint part that verifies is returned.

Where q-grams would leave an item fewer than e edits (T under 1), grams of SHORT_Q characters take their place; an item of fewer than q characters
counts where its whole tokens occur. Pairs of equal grams are met for one item and one stretch of the text at a time, so that memory grows with the
text and not with the pairs, however often both repeat a gram.

The q-gram index is sent to the workers in shards of at most `shard_chars` characters of items; documents are scanned once a shard.

Defined results: an item without letters and digits is ignored, since it says nothing. With other rates than the given one e is less where T
would be under 1 even so. A null
text is empty and clean, a null item is ignored; item_id may be null or repeated, each row of the benchmark is an item. Without items all
documents are clean. Repeated rows come out as often as they went in; other columns go through unchanged; `matches` (or the name given) is replaced: an array
of (item_id, start, edits), with the place in the normal form where the part begins (by the item's length before its end), empty for clean documents.
"""

from __future__ import annotations

import re
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import fresh, key_hash, prepare, stored

Q, SHORT_Q, RATE, SHARD_CHARS = 7, 4, 0.12, 4_000_000
#: Pairs of equal q-grams, and cells of a run, that are looked at at a time.
HITS, RUN = 1_000_000, 4096
_OTHER = re.compile(r"[\W_]+")
BITS = 22


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all runs of q codes."""
    h = np.zeros(max(0, len(c) - q + 1), W.U)
    for i in range(q):
        h *= W.U(0x9E3779B97F4A7C15)
        h += c[i : i + len(h)]
    return W.mix(h)


def budget(m: int, q: int = Q, rate: float = RATE) -> tuple[int, int]:
    """(edits, q-grams that must be shared)."""
    e = max(0, min(int(rate * m), (m - q) // q))
    return e, m - q + 1 - q * e


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> np.ndarray:
    """For each diagonal low..high the fewest edits that turn a part of text, ending there, into item, by alignments that stay on these diagonals;
    all are over `most` where none is within."""
    width = high - low + 1
    far = most + 1
    at = np.arange(width)
    row = np.where((low + at >= 0) & (low + at <= len(text)), 0, far)  # row i, band place k: item[:i] against a part that ends at text place i + low + k
    for i in range(1, len(item) + 1):
        j = i + low + at
        ok = (j >= 1) & (j <= len(text))
        differs = np.ones(width, row.dtype)
        differs[ok] = text[j[ok] - 1] != item[i - 1]
        new = np.where(ok, row + differs, far)  # both
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # a character of the item only
        new[(j < 0) | (j > len(text))] = far
        row = np.minimum(np.minimum.accumulate(new - at) + at, far)  # characters of the text only
        row[(j < 0) | (j > len(text))] = far
        if row.min() > most:
            break
    return row


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> int | None:
    """The fewest edits that turn some part of text into item, over alignments that stay on diagonals low..high; None if over `most`."""
    found = int(aligned(item, text, low, high, most).min())
    return found if found <= most else None


def regions(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> list[tuple[int, int]]:
    """(end in text, edits) of disjoint parts of text within `most` edits of item, over alignments that stay on diagonals low..high."""
    row = aligned(item, text, low, high, most)
    ends, out, free = np.flatnonzero(row <= most), [], -1
    for k in ends.tolist():
        if k < free:
            continue
        near = ends[np.searchsorted(ends, k) : np.searchsorted(ends, k + most + 1)]
        best = int(near[np.argmin(row[near])])
        out.append((len(item) + low + best, int(row[best])))
        free = best + max(1, len(item) - most)
    return out


class Index:
    """Items of Q characters or more, by their q-grams."""

    def __init__(self, items: list[tuple[int | None, str]], q: int, rate: float):
        found = [(i, t) for i, t in items if len(t) >= q]
        self.q, self.ids, self.texts = q, [i for i, _ in found], [t for _, t in found]
        self.codes = [codes(t) for t in self.texts]
        self.edits, self.least = (np.array(x, np.int64) for x in zip(*(budget(len(c), q, rate) for c in self.codes))) if found else (np.zeros(0, np.int64),) * 2
        h = np.concatenate([np.zeros(0, W.U), *(grams(c, q) for c in self.codes)])
        item = np.concatenate([np.zeros(0, np.int64), *(np.full(len(c) - q + 1, n) for n, c in enumerate(self.codes))])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(c) - q + 1) for c in self.codes)])
        order = np.argsort(h, kind="stable")
        self.h, gram = np.unique(h, return_inverse=True)
        self.first = np.append(np.searchsorted(h[order], self.h), len(h))
        self.item, self.place = item[order], place[order]
        # of each item its grams, sorted, and their places
        cut = np.searchsorted(item, np.arange(len(found) + 1))
        self.own = []
        for a, b in zip(cut[:-1], cut[1:]):
            place = np.argsort(gram[a:b], kind="stable")
            self.own.append((gram[a:b][place], place))
        self.some = np.zeros(1 << BITS, bool)
        self.some[(self.h >> W.U(64 - BITS)).astype(np.int64)] = True

    def matches(self, text: str) -> list[dict]:
        c = codes(text)
        h = grams(c, self.q)
        at = np.flatnonzero(self.some[(h >> W.U(64 - BITS)).astype(np.int64)])
        if not len(at) or not len(self.h):
            return []
        g = np.minimum(np.searchsorted(self.h, h[at]), len(self.h) - 1)
        hit = self.h[g] == h[at]
        at, g = at[hit], g[hit]
        if not len(at):
            return []
        n = self.first[g + 1] - self.first[g]
        if n.sum() <= HITS:
            items = self._banded(at, self._postings(g, n), n)
        else:  # the places of each item that the text has anywhere: no region can have more
            there = np.unique(g)
            which = self._postings(there, self.first[there + 1] - self.first[there])
            items = np.flatnonzero(np.bincount(self.item[which], minlength=len(self.ids)) >= self.least)
        return [m for i in items.tolist() for m in self._found(i, text, c, at, g)]

    def _postings(self, g: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(self.first[g] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))

    def _banded(self, at: np.ndarray, which: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The items of which some band has enough hits, for all items at once."""
        item = self.item[which]
        keep = np.flatnonzero((np.bincount(item, minlength=len(self.ids)) >= self.least)[item])
        if not len(keep):
            return keep
        item = item[keep]
        cell = np.sort((item << 40) + (1 << 39) + (np.repeat(at, n)[keep] - self.place[which[keep]]) // (self.edits[item] + 1))
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        cells, size = cell[first], np.diff(np.append(first, len(cell)))
        count = size + np.append(np.where(cells[1:] == cells[:-1] + 1, size[1:], 0), 0)
        return np.unique(cells[count >= self.least[cells >> 40]] >> 40)

    def _found(self, i: int, text: str, c: np.ndarray, at: np.ndarray, g: np.ndarray) -> list[dict]:
        """The disjoint regions of the text that hold item i. Memory: the text, and HITS places at a time."""
        own, place = self.own[i]
        lo = np.searchsorted(own, g)
        hit = own[np.minimum(lo, len(own) - 1)] == g
        at, lo = at[hit], lo[hit]
        n = np.searchsorted(own, g[hit], "right") - lo
        e, m, least = int(self.edits[i]), len(self.codes[i]), int(self.least[i])
        if not len(at) or n.sum() < least:
            return []
        # cells of e + 1 diagonals; a band is a cell and the next one
        base = (int(at[0]) - m) // (e + 1)
        count = np.zeros((int(at[-1]) + 1) // (e + 1) - base + 2, np.int64)
        parts = np.searchsorted(np.cumsum(n), np.arange(HITS, int(n.sum()) + HITS, HITS), "right") if n.sum() > HITS else [len(at)]
        a, kept = 0, []
        for b in sorted({min(max(int(x), 1), len(at)) for x in [*parts, len(at)]}):
            size = n[a:b]
            total = int(size.sum())
            of = np.repeat(lo[a:b] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
            cell = (np.repeat(at[a:b], size) - place[of]) // (e + 1) - base
            least_cell = int(cell.min()) if total else 0
            step = np.bincount(cell - least_cell)
            count[least_cell : least_cell + len(step)] += step
            kept.append((cell, place[of]))
            if b < len(at):
                kept = []  # too many to look at their places
            a = b
        band = count[:-1] + count[1:]
        good = np.flatnonzero((band >= least) & (count[:-1] > 0))
        if len(parts) == 1 and len(good):
            cell, places = kept[0]
            order = np.argsort(cell, kind="stable")
            cell, places = cell[order], places[order]
            good = good[[len(np.unique(places[slice(*np.searchsorted(cell, [k, k + 2]))])) >= least for k in good.tolist()]]
        out, free = [], -1
        for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else []:
            for k in range(0, len(run), RUN):
                low, high = ((int(x) + base) * (e + 1) for x in (run[k], run[min(k + RUN, len(run)) - 1]))
                start = text.find(self.texts[i], max(0, low), max(0, high + 2 * e + 2) + m) if len(run) <= 3 else -1
                for end, edits in [(start + m, 0)] if start >= 0 else regions(self.codes[i], c, low - e - 1, high + 2 * e + 1, e):
                    if end - m + e >= free:  # runs may meet in one region
                        out.append({"item_id": self.ids[i], "start": max(0, end - m), "edits": edits})
                        free = end
        return out


class Tokens:
    """Items too short for q-grams: equal runs of whole tokens."""

    def __init__(self, items: list[tuple[int | None, str]], q: int):
        self.items: dict[tuple[str, ...], list] = {}
        for i, t in items:
            if t and len(t) < q:
                self.items.setdefault(tuple(t.split(" ")), []).append(i)
        self.sizes = sorted({len(k) for k in self.items})

    def matches(self, text: str) -> list[dict]:
        if not self.items:
            return []
        words = text.split(" ")
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        out = []
        for n in self.sizes:
            for k, run in enumerate(zip(*(words[j:] for j in range(n)))):
                out += [{"item_id": i, "start": int(starts[k]), "edits": 0} for i in self.items.get(run, ())]
        return out


class Matcher:
    """All items: by Q-grams of q characters where these leave the whole edit budget, else of SHORT_Q, else by tokens."""

    def __init__(self, items: list[tuple[int | None, str]], q: int, rate: float):
        whole = [(i, t) for i, t in items if len(t) >= q and budget(len(t), q, rate)[0] == int(rate * len(t))]
        rest = [(i, t) for i, t in items if len(t) >= q and budget(len(t), q, rate)[0] < int(rate * len(t))]
        small = min(q, SHORT_Q)
        self.ways = [w for w, n in ((Index(whole, q, rate), len(whole)), (Index(rest, small, rate), len(rest)), (Tokens(items, q), 1)) if n]

    def matches(self, text: str) -> list[dict]:
        return [m for way in self.ways for m in way.matches(text)]


FORM = T.ArrayType(T.StructType().add("item_id", "long").add("start", "long").add("edits", "integer"))


def _matcher(index: Matcher):
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([index.matches(normal(t)) for t in texts], dtype=object)

    return run


def find(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, shard_chars: int = SHARD_CHARS, into: str = "matches") -> DataFrame:
    """docs with `into`, the items (item_id, text of benchmark) that each document holds."""
    spark = docs.sparkSession
    prepare(spark)
    own = docs.drop(into)
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(1, ceil(chars / shard_chars))

    def matches(s: int) -> Column:
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s).collect()  # about shard_chars characters
        return F.pandas_udf(_matcher(Matcher([(r.item_id, normal(r.text)) for r in rows], q, rate)), FORM)(F.coalesce("text", F.lit("")))

    if shards == 1:
        return own.withColumn(into, matches(0))
    # one index in a worker at a time: hits of each shard are stored, and joined to their texts at the end
    key, of = fresh("key", own), fresh("of", own)
    text_key = F.struct(*(c.alias(n) for c, n in zip(key_hash(F.coalesce("text", F.lit(""))), "ab")))
    texts = own.select(text_key.alias(of), "text")
    hits = [stored(texts.withColumn("m", matches(s)).filter(F.size("m") > 0).select(of, F.explode("m").alias("m")).distinct(), "hits") for s in range(shards)]
    found = reduce(DataFrame.unionByName, hits).groupBy(of).agg(F.collect_list("m").alias(into))
    both = own.withColumn(key, text_key).join(found, F.col(key) == F.col(of), "left")
    return both.select(*own.columns, F.coalesce(into, F.array().cast(FORM)).alias(into))


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """The documents that hold no item, with the columns of docs."""
    name = fresh("matches", docs)
    return find(docs, benchmark, q, rate, into=name).filter(F.size(name) == 0).drop(name)
