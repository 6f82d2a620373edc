"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their beginnings of 4, 5 and 6 bytes (ASCII punctuation separates, A-Z is folded), by hash. Of the labelled
examples' terms those are kept whose log-likelihood ratio for the label is `min_gain` at least and that are found in at least `min_docs`
examples. A
vector has (1 + ln tf) * idf for the kept terms and a constant term BIAS, so that a text without kept terms still has a direction, that of
the ordinary examples. Examples with equal vectors are one entry with counts.

The index has blocks of entries, with the largest weight of each term in each block. A query takes the FIRST blocks of largest upper bound,
then all whose bound reaches the k-th cosine found there; the k nearest are those of the full scan. Entries vote with weight
cosine ** SHARPNESS times their count; a prior of one vote at the examples' rate is added. Votes become scores by isotonic calibration, fitted on
the examples' own votes with one of their count left out.

Fitting uses a bounded sample: of the labelled documents that are there the `max_examples` of smallest hash. Everything else covers all documents. The
evidence of a score is the nearest entries: their smallest example doc_id, cosine and share of label 1.

Defined results: a null text is like an empty one, and each document gets a score, empty texts too. Labels with a null doc_id or a label
other than 0 and 1 are ignored; a document labelled both ways counts as 1; repeated labels count once, repeated documents as one example by
their smallest text hash. Without any examples the score is 0. Repeated rows come out as often as they went in; other columns go through
unchanged; `score` and `evidence` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import fresh, prepare, stored

MAX_EXAMPLES, MIN_DOCS, MIN_GAIN = 6000, 5, 5.0
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6)
BIAS, SHARPNESS, NEAREST, BLOCK, FIRST = 1.0, 8, 15, 64, 8


def terms(data: np.ndarray, at: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) for each distinct term, sorted; only those of the sorted array `among`, if given."""
    words = W.split(data, at, W.PUNCTUATION, fold=True)
    docs = words.docs
    size = words.end - words.start
    found = [(docs, words.hashes())]
    for n in BEGINNINGS:
        long = np.flatnonzero(size >= n)
        found.append((docs[long], words.prefix(words.start[long] + n, long) ^ W.U(n)))
    if among is not None:
        some = np.zeros(1 << 16, bool)
        some[(among & W.U(0xFFFF)).astype(np.int64)] = True
        found = [(d[m], h[m]) for d, h in found for m in [some[(h & W.U(0xFFFF)).astype(np.int64)]]]
    doc, term = (np.concatenate(x) for x in zip(*found))
    if among is not None:
        hit = np.zeros(len(term), bool) if not len(among) else among[np.minimum(np.searchsorted(among, term), len(among) - 1)] == term
        doc, term = doc[hit], term[hit]
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return doc[first], term[first], np.diff(np.append(first, len(doc)))


def _example_terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        ids, label = (batch.column(k).to_numpy() for k in ("doc_id", "label"))
        for i, _, data, at in W.chunks(batch.column("text")):
            doc, term, tf = terms(data, at)
            yield pa.record_batch([pa.array(x) for x in (ids[doc + i], label[doc + i], term.view(np.int64), tf.astype(np.int32))], names=["doc_id", "label", "term", "tf"])


@dataclass
class Index:
    """Entries (distinct vectors of examples) in blocks. terms is sorted; postings of the term at place t in block b are
    start[t * blocks + b]:start[t * blocks + b + 1]."""

    terms: np.ndarray
    idf: np.ndarray
    start: np.ndarray
    entry: np.ndarray
    weight: np.ndarray
    most: np.ndarray  # (terms + 1, blocks): the largest weight of each term; last the constant term
    bias: np.ndarray  # of each entry
    ones: np.ndarray
    count: np.ndarray
    example: np.ndarray  # smallest doc_id
    rate: float
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))  # votes, scores

    def vector(self, place: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, float]:
        w = (1 + np.log(tf)) * self.idf[place]
        norm = float(np.sqrt(np.dot(w, w) + BIAS**2))
        return w / norm, BIAS / norm

    def nearest(self, place: np.ndarray, tf: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines) of the k nearest, nearest first, ties to the smaller entry."""
        w, b = self.vector(place, tf)
        bound = w @ self.most[place] + b * self.most[-1]
        order = np.argsort(-bound, kind="stable")
        ids, cos = self._cosines(place, w, b, order[:FIRST])
        if len(order) > FIRST:
            least = np.partition(cos, len(cos) - k)[len(cos) - k] if len(cos) >= k else -1.0
            more = order[FIRST:][bound[order[FIRST:]] >= least - 1e-9]
            if len(more):
                ids, cos = (np.concatenate(x) for x in zip((ids, cos), self._cosines(place, w, b, more)))
        best = np.lexsort((ids, -cos))[:k]
        return ids[best], cos[best]

    def _cosines(self, place: np.ndarray, w: np.ndarray, b: float, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All entries of some blocks with their cosines."""
        all_ = self.most.shape[1]
        if 4 * len(blocks) > all_:  # a term's postings as a whole
            low, n = self.start[place * all_], self.start[(place + 1) * all_] - self.start[place * all_]
        else:
            cell = (place[:, None] * all_ + blocks).ravel()
            low, n, w = self.start[cell], self.start[cell + 1] - self.start[cell], np.repeat(w, len(blocks))
        which = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        got = np.bincount(self.entry[which], np.repeat(w, n) * self.weight[which], len(self.bias))
        ids = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        ids = ids[ids < len(self.bias)]
        return ids, got[ids] + b * self.bias[ids]

    def vote(self, ids: np.ndarray, cos: np.ndarray, but: int = -1, label: int = 0) -> float:
        """The weighted share of label 1; `but`: the entry of which one example with that label is left out."""
        w = np.clip(cos, 0, 1) ** SHARPNESS
        ones, count = self.ones[ids] - (ids == but) * label, self.count[ids] - (ids == but)
        return float((np.dot(w, ones) + self.rate) / (np.dot(w, count) + 1))

    def score(self, vote: float) -> float:
        return float(np.interp(vote, *self.steps)) if len(self.steps[0]) else vote


def isotonic(x: np.ndarray, ones: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (both ends of each pool, its rate) of a non-decreasing fit, each rate smoothed by half a success."""
    pools: list[list[float]] = []  # least x, largest x, ones, count
    for a, o, c in sorted(zip(x.tolist(), ones.tolist(), count.tolist())):
        pools.append([a, a, o, c])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, high, o2, c2 = pools.pop()
            pools[-1] = [pools[-1][0], high, pools[-1][2] + o2, pools[-1][3] + c2]
    rate = np.maximum.accumulate(np.array([(o + 0.5) / (c + 1) for *_, o, c in pools])) if pools else np.zeros(0)
    return np.array([e for p in pools for e in p[:2]]), np.repeat(rate, 2)


def build(rows: pd.DataFrame, examples: pd.DataFrame, kept: np.ndarray, df: np.ndarray) -> Index:
    """rows: doc_id, term, tf of kept terms; examples: doc_id, label of all; kept: sorted terms with their document counts df."""
    n = len(examples)
    idf = np.log((n + 1) / (df + 1)) + 1 if n else np.zeros(0)
    by_doc = {d: (g["term"].to_numpy().view(np.uint64), g["tf"].to_numpy()) for d, g in rows.sort_values(["doc_id", "term"]).groupby("doc_id")}
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    entries: dict[bytes, list] = {}
    for d, y in examples.sort_values("doc_id")[["doc_id", "label"]].itertuples(index=False):
        t, tf = by_doc.get(d, none)
        place = np.searchsorted(kept, t)
        e = entries.setdefault(place.tobytes() + tf.astype(np.int64).tobytes(), [place, tf, 0, 0, d])
        e[2] += y
        e[3] += 1
    # alike entries next to each other: blocks then have tight bounds
    found = sorted(entries.values(), key=lambda e: (e[0].tolist(), e[1].tolist()))
    index = Index(kept, idf, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((len(kept) + 1, -(-len(found) // BLOCK))), np.zeros(len(found)), *(np.array([e[i] for e in found], np.int64) for i in (2, 3, 4)), rate=float(examples["label"].mean()) if n else 0.0)
    postings = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i, (place, tf, *_) in enumerate(found):
        w, b = index.vector(place, tf)
        index.bias[i] = b
        index.most[-1, i // BLOCK] = max(index.most[-1, i // BLOCK], b)
        index.most[place, i // BLOCK] = np.maximum(index.most[place, i // BLOCK], w)
        postings.append((place, np.full(len(place), i), w))
    place, entry, weight = (np.concatenate(x) for x in zip(*postings))
    order = np.lexsort((entry, place))
    index.entry, index.weight = entry[order], weight[order]
    blocks = index.most.shape[1]
    index.start = np.searchsorted(place[order] * blocks + index.entry // BLOCK, np.arange(len(kept) * blocks + 1))
    votes = []
    for i, (place, tf, ones, count, _) in enumerate(found):
        near = index.nearest(place, tf)
        votes += [(index.vote(*near, i, y), y, c) for y, c in ((1, ones), (0, count - ones)) if c]
    if votes:
        v, y, c = (np.array(x, float) for x in zip(*votes))
        index.steps = isotonic(v, y * c, c)
    return index


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, min_docs: int = MIN_DOCS, min_gain: float = MIN_GAIN) -> Index:
    """labels: doc_id, label. The index is bounded by max_examples, since each kept term takes min_docs of them at least."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("label").cast("int")).alias("label"))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    some = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples), "sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(some), "doc_id")  # at most max_examples rows
    texts = texts.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = stored(texts.mapInArrow(_example_terms, "doc_id long, label int, term long, tf int"), "examples")
    examples = some.toPandas()
    n1 = int(examples["label"].sum()) if len(examples) else 0
    n0 = len(examples) - n1
    count = rows.groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).filter(F.col("a") + F.col("b") >= min_docs)

    def part(k: Column, n: Column) -> Column:
        return F.when(k > 0, k * F.log(k / n)).otherwise(0.0)

    both = F.col("a") + F.col("b")
    if n0 and n1:
        a0, b0 = n1 - F.col("a"), n0 - F.col("b")
        gain = part(F.col("a"), both * n1 / (n0 + n1)) + part(F.col("b"), both * n0 / (n0 + n1)) + part(a0, (n0 + n1 - both) * n1 / (n0 + n1)) + part(b0, (n0 + n1 - both) * n0 / (n0 + n1))
        kept = count.withColumn("gain", gain).filter(F.col("gain") >= min_gain)
    else:
        kept = count.limit(0)
    top = kept.select("term", (F.col("a") + F.col("b")).alias("df")).toPandas()
    order = np.argsort(top["term"].to_numpy(np.int64).view(np.uint64))
    terms_, df = top["term"].to_numpy(np.int64).view(np.uint64)[order], top["df"].to_numpy(np.float64)[order]
    ours = spark.createDataFrame([(int(x),) for x in terms_.view(np.int64)], "term long")
    hits = rows.join(F.broadcast(ours), "term").select("doc_id", "term", "tf").toPandas()  # postings of max_examples texts
    return build(hits, examples, terms_, df)


FORM = T.StructType().add("score", "double").add("evidence", T.ArrayType(T.StructType().add("doc_id", "long").add("cosine", "double").add("share", "double")))


def _scorer(index: Index, cited: int):
    none = np.zeros(0, np.int64)
    seen: dict[bytes, tuple] = {}

    def one(place: np.ndarray, tf: np.ndarray) -> tuple:
        key = place.tobytes() + tf.tobytes()
        if key not in seen:
            if len(seen) > 10_000:
                seen.clear()
            ids, cos = index.nearest(place, tf)
            seen[key] = (index.score(index.vote(ids, cos)), [{"doc_id": int(index.example[i]), "cosine": float(c), "share": float(index.ones[i] / index.count[i])} for i, c in zip(ids[:cited], cos)])
        return seen[key]

    def run(texts: pd.Series) -> pd.DataFrame:
        out = [None] * len(texts)
        for i, j, data, at in W.chunks(pa.array(texts, pa.binary())):
            doc, term, tf = terms(data, at, index.terms)
            place, cut = np.searchsorted(index.terms, term), np.searchsorted(doc, np.arange(j - i + 1))
            for r in range(j - i):
                a, b = cut[r], cut[r + 1]
                out[i + r] = one(place[a:b], tf[a:b]) if b > a else one(none, none)
        return pd.DataFrame(out, columns=["score", "evidence"])

    return run


def score(docs: DataFrame, index: Index, cited: int = 3) -> DataFrame:
    """docs with score (0 to 1) and evidence, an array of (doc_id, cosine, share)."""
    prepare(docs.sparkSession)
    own = docs.drop("score", "evidence")
    done = fresh("done", own)
    scorer = F.pandas_udf(_scorer(index, cited), FORM)
    return own.withColumn(done, scorer(F.coalesce("text", F.lit("")).cast("binary"))).select(*own.columns, f"{done}.*")
