"""Removal of repeated passages by seed and extension.

Seeds: of each `length`-word window the smallest hash of its `gram`-word grams (leftmost on ties) is its anchor, so equal windows have
equal anchors at equal offsets. Successive windows with one anchor form an envelope. Documents are joined on anchors; an anchor
found in one document only is done with. Extension goes both ways to the envelope's ends: where whole envelopes are equal, all but
the smallest document's copies are covered. Where one anchor has different envelopes, only those of the smallest document of each are
extended window by window. A group of n copies so costs n rows, not n squared pairs, and no link is lost. Covered windows that
touch are merged to maximal repeats, and the words of these go. Hashes of envelopes and windows have 128 bits.

Defined results: words are runs of anything but [\\x20\\x09-\\x0D], unchanged. A word goes if some window that covers it also starts in
a document with a smaller doc_id, judged on the input. A null text has no words. Rows of one doc_id are one document and never lose words
to each other; rows with a null doc_id lose nothing and cause no loss. Repeated rows lose the same words. Other columns go through
unchanged; `kept`, `n_words` and `n_removed` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import discard, fresh, prepare, stored

LENGTH, GRAM = 50, 10
ONE, TWO = 0xA24BAED4963EE407, 0x9FB21C651E98DF25


def _named(names: str, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols], names=names.split())


def _anchors(length: int, gram: int):
    width = length - gram + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "text_hash"))
            for i, _, data, at in W.chunks(batch.column("text")):
                words = W.split(data, at)
                h = words.hashes()
                if len(h) < length:
                    continue
                doc = words.docs
                n = len(h) - length + 1
                start = np.flatnonzero(doc[:n] == doc[length - 1 :])
                if not len(start):
                    continue
                grams = W.rolling(h, gram)
                pick = np.concatenate([sliding_window_view(grams, width)[a : a + W.BLOCK].argmin(axis=1) for a in range(0, n, W.BLOCK)])[start] + start
                turn = np.ones(len(start), bool)
                turn[1:] = (pick[1:] != pick[:-1]) | (start[1:] != start[:-1] + 1)
                at_turn = np.flatnonzero(turn)
                lo, hi = start[at_turn], start[np.append(at_turn[1:], len(start)) - 1]
                own = doc[lo] + i
                first = words.first[doc[lo]]
                yield _named("doc_id text_hash anchor e1 e2 lo hi", ids[own], hashes[own], grams[pick[at_turn]], W.spans(h, lo, hi + length, ONE), W.spans(h, lo, hi + length, TWO), (lo - first).astype(np.int32), (hi - first).astype(np.int32))

    return run


def _windows(length: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "text_hash"))
            ends = batch.column("ends").to_pylist()
            for i, j, data, at in W.chunks(batch.column("text")):
                words = W.split(data, at)
                h = words.hashes()
                for row in range(i, j):
                    first = int(words.first[row - i])
                    lo, hi = (np.array([e[k] for e in ends[row]], np.int64) for k in ("lo", "hi"))
                    n = hi - lo + 1
                    start = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    at_start = start + first
                    some = np.full(len(start), 0, np.int64)
                    own = h[first : int(words.first[row - i + 1])]
                    yield _named("doc_id text_hash w1 w2 start", some + ids[row], some + hashes[row], W.spans(own, start, start + length, ONE), W.spans(own, start, start + length, TWO), (at_start - first).astype(np.int32))

    return run


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash, parts: for each text that repeats what a smaller doc_id has, the intervals of words covered (lo, end), not merged."""
    prepare(docs.sparkSession)
    if not 1 <= gram <= length:
        raise ValueError("gram must lie between 1 and length")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    seeds = stored(own.mapInArrow(_anchors(length, gram), "doc_id long, text_hash long, anchor long, e1 long, e2 long, lo int, hi int"), "anchors")
    shared = stored(seeds.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor"), "shared")
    every, seeds = seeds, stored(seeds.join(shared, "anchor", "left_semi"), "seeds")
    discard(every, shared)
    kinds = stored(seeds.groupBy("anchor", "e1", "e2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "envelopes")
    # stored: in a join of two plain tables the rows of a frequent anchor can be split, one with a grouping below cannot
    unlike = stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", F.lit(True).alias("unlike")), "unlike")
    kinds = kinds.join(unlike, "anchor", "left").filter("least < most OR unlike").select("e1", "e2", "least", F.coalesce("unlike", F.lit(False)).alias("unlike"))
    met = stored(seeds.select("doc_id", "text_hash", "e1", "e2", "lo", "hi").join(kinds, ["e1", "e2"]).filter("doc_id > least OR unlike").select("doc_id", "text_hash", "lo", "hi", (F.col("doc_id") > F.col("least")).alias("covered")), "met")
    discard(seeds)
    extend = met.filter("NOT covered").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("lo", "hi")).alias("ends"))
    texts = own.join(extend, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "ends")
    windows = stored(texts.mapInArrow(_windows(length), "doc_id long, text_hash long, w1 long, w2 long, start int"), "windows")
    least = stored(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("w1", "w2", "least"), "least")
    late = stored(windows.join(least, ["w1", "w2"]).filter("doc_id > least").select("doc_id", "text_hash", "start"), "late")
    discard(windows, least)
    covered = met.filter("covered").select("doc_id", "text_hash", "lo", (F.col("hi") + length).alias("end"))
    covered = covered.unionByName(late.select("doc_id", "text_hash", F.col("start").alias("lo"), (F.col("start") + length).alias("end")))
    return covered.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("lo", "end")).alias("parts"))


def maximal(parts: list[dict]) -> list[tuple[int, int]]:
    """Intervals that touch or overlap, merged."""
    out: list[list[int]] = []
    for lo, end in sorted((p["lo"], p["end"]) for p in parts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return [(a, b) for a, b in out]


@F.pandas_udf(T.ArrayType(T.StructType().add("start", "long").add("end", "long")))
def _maximal(parts: pd.Series) -> pd.Series:
    return pd.Series([maximal(p) for p in parts], dtype=object)


def maximal_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash, spans: the maximal runs of words to remove, as [start, end) in words."""
    return repeats(docs, length, gram).select("doc_id", "text_hash", _maximal("parts").alias("spans"))


@F.pandas_udf(T.StructType().add("kept", "string").add("n_words", "long").add("n_removed", "long"))
def _applied(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    def one(t: bytes, gone: list | None) -> tuple[str, int, int]:
        words = (t or b"").split()
        n = len(words)
        if gone is not None:
            at = [0, *(x for s in gone for x in (s["start"], s["end"])), n]
            words = [w for a, b in zip(at[::2], at[1::2]) for w in words[a:b]]
        return b" ".join(words).decode("utf-8", "replace"), n, n - len(words)

    return pd.DataFrame([one(t, s) for t, s in zip(text, spans)], columns=["kept", "n_words", "n_removed"])


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with kept (the words that stay, joined by one space), n_words and n_removed."""
    own = docs.drop("kept", "n_words", "n_removed")
    key, of, spans, done = (fresh(x, own) for x in ("key", "of", "spans", "done"))

    def named(*cols: Column) -> Column:
        return F.struct(cols[0].alias("a"), cols[1].alias("b"))

    found = maximal_repeats(docs, length, gram).select(named(F.col("doc_id"), F.col("text_hash")).alias(of), F.col("spans").alias(spans))
    keyed = own.withColumn(key, named(F.col("doc_id").cast("long"), F.xxhash64("text")))
    return keyed.join(found, keyed[key] == found[of], "left").withColumn(done, _applied(F.col("text").cast("binary"), spans)).select(*own.columns, f"{done}.*")
