"""Topics learnt from words: spherical k-means over hashed TF-IDF vectors.

A text's vector has, for each of DIMS hash buckets of its words, (1 + ln tf) * idf, scaled to length one; its topic is the nearest of the
centroids. idf, seeds and centroids are fitted on all rows: the buckets and counts of every text are stored once in the shared folder, and each
step is a pass over that table of which only sums by bucket (and cluster) or one row come to the driver. Vectors and centroids are whole
multiples of 2 ** -15 and 2 ** -24, so that sums and products are exact in 53 bits: the same rows give the same topics, however they are dealt out.

Seeds are chosen as in k-means++, by an exponential race of all rows with a number from the row's hash, so no row is left out. The first rows of a
race are taken in turn, each with the share of its distance that the seeds taken since then have left.

Defined results: words are runs of anything but [\\x20\\x09-\\x0D], A-Z folded. A text without words, null included, and any text where nothing was
fitted, has the topic `none`; others are `t0`, `t1`, ... Repeated rows have one topic. Other columns go through unchanged; `n_tokens` and `topic` are
replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import discard, fresh, prepare, stored

DIMS, TOPICS, ROUNDS, SEED = 2048, 8, 20, 5
UNIT, FINE = float(1 << 15), float(1 << 24)
#: Rows nearer than this to a seed can't become one.
LEAST = 1e-4
#: Rows made dense at a time; cells in a block of the stored tables, about; sums in a row on their way to the driver.
DENSE, CELLS, WIDE = 32, 1 << 14, 32


@dataclass
class Topics:
    """centroids: whole multiples of 1 / FINE."""

    idf: np.ndarray
    centroids: np.ndarray


def counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words of each text, cells that occur, their counts) for runs of texts; a cell is DIMS times the text's place in its run, plus the bucket."""
    for i, j, data, at in W.chunks(texts):
        words = W.split(data, at, fold=True)
        cell = words.docs * DIMS + (words.hashes() >> W.U(64 - DIMS.bit_length() + 1)).astype(np.int64)
        n = np.bincount(cell, minlength=(j - i) * DIMS)
        found = np.flatnonzero(n)
        yield np.diff(words.first), found, n[found]


@dataclass
class Block:
    """Rows by bucket, without zeros. size: buckets of each row; value: counts, or vectors times UNIT."""

    hash: np.ndarray
    size: np.ndarray
    bucket: np.ndarray
    value: np.ndarray

    TYPES = {"hash": np.int64, "size": np.int32, "bucket": np.uint16, "value": np.uint16}
    COUNTS = TYPES | {"value": np.uint32}

    @classmethod
    def all(cls, it: Iterator[pa.RecordBatch], types: dict = TYPES) -> Iterator[Block]:
        for batch in it:
            for i in range(batch.num_rows):
                yield cls(*(np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in types.items()))

    def packed(self, types: dict = TYPES) -> pa.RecordBatch:
        return pa.record_batch([pa.array([getattr(self, k).astype(t, copy=False).tobytes()], pa.binary()) for k, t in types.items()], names=list(types))

    def vectors(self, idf: np.ndarray) -> Block:
        row = np.repeat(np.arange(len(self.size)), self.size)
        weight = (1 + np.log(self.value)) * idf[self.bucket]
        length = np.sqrt(np.bincount(row, weight * weight, len(self.size)))
        return Block(self.hash, self.size, self.bucket, np.rint(weight / length[row] * UNIT))

    def products(self, centroids: np.ndarray) -> np.ndarray:
        """Of vectors with centroids."""
        at, out = np.concatenate([[0], np.cumsum(self.size)]), np.zeros((len(self.size), len(centroids)))
        dense, down = np.zeros((DENSE, DIMS)), np.ascontiguousarray(centroids.T)
        for i in range(0, len(self.size), DENSE):
            some = self.size[i : i + DENSE]
            a, b = at[i], at[i + len(some)]
            cell = np.repeat(np.arange(len(some)) * DIMS, some) + self.bucket[a:b]
            dense.ravel()[cell] = self.value[a:b]
            out[i : i + len(some)] = dense[: len(some)] @ down
            dense.ravel()[cell] = 0
        return out


STORED = ", ".join(f"{k} binary" for k in Block.TYPES)


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of counts of the texts that have words."""
    for batch in it:
        h, done = batch.column("hash").to_numpy(), 0
        for n, cell, tf in counts(batch.column("text")):
            own, done = h[done : done + len(n)], done + len(n)
            size = np.bincount(cell // DIMS, minlength=len(n))
            own, size = own[size > 0], size[size > 0]
            at = np.concatenate([[0], np.cumsum(size)])
            i = 0
            while i < len(size):
                j = max(i + 1, int(np.searchsorted(at, at[i] + CELLS, "right")) - 1)
                yield Block(own[i:j], size[i:j], cell[at[i] : at[j]] % DIMS, tf[at[i] : at[j]]).packed(Block.COUNTS)
                i = j


def _summed(rows: DataFrame, size: int, add: Callable[[np.ndarray, Block], None], types: dict = Block.TYPES) -> np.ndarray:
    """What add(sums, block) adds up over all blocks, whole numbers: `size` of them."""
    names = [f"s{i}" for i in range(WIDE)]

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(-(-size // WIDE) * WIDE)
        for block in Block.all(it, types):
            add(sums[:size], block)
        wide = sums.astype(np.int64).reshape(-1, WIDE)
        at = np.flatnonzero(wide.any(axis=1))
        yield pa.record_batch([pa.array(at), *(pa.array(wide[at, i]) for i in range(WIDE))], names=["at", *names])

    found = rows.mapInArrow(task, ", ".join(f"{k} long" for k in ("at", *names))).groupBy("at").agg(*(F.sum(k).alias(k) for k in names)).toPandas()
    out = np.zeros((-(-size // WIDE), WIDE))
    out[found["at"].to_numpy(np.int64)] = found[names].to_numpy(float)
    return out.ravel()[:size]


def _documents(sums: np.ndarray, block: Block) -> None:
    """Rows by bucket, and all rows."""
    sums[:DIMS] += np.bincount(block.bucket, minlength=DIMS)
    sums[DIMS] += len(block.size)


def _nearest(centroids: np.ndarray) -> Callable[[np.ndarray, Block], None]:
    """Vectors by cluster and bucket."""

    def add(sums: np.ndarray, block: Block) -> None:
        at = np.repeat(block.products(centroids).argmax(axis=1), block.size) * DIMS + block.bucket
        sums += np.bincount(at, block.value, len(sums))

    return add


def _scaled(x: np.ndarray) -> np.ndarray:
    return np.rint(x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12) * FINE)


def _chance(h: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in (0, 1)."""
    return ((W.mix(h.view(W.U) ^ W.mix(np.array([SEED * 1000 + turn], W.U))) >> W.U(11)) + 0.5) / float(1 << 53)


def _far(products: np.ndarray) -> np.ndarray:
    return 1 - products.max(axis=1, initial=0) / (UNIT * FINE)


def _race(centroids: np.ndarray, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task's first rows in a race where a row runs as fast as it is far from all centroids; rows at a centroid don't run."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = []
        for block in Block.all(it):
            far = _far(block.products(centroids))
            time = np.where(far > LEAST, -np.log(_chance(block.hash, len(centroids))) / np.maximum(far, LEAST), np.inf)
            at, last = np.concatenate([[0], np.cumsum(block.size)]), best[-1][0] if len(best) == most else np.finfo(float).max
            for i in np.lexsort((block.hash, time))[:most]:
                if time[i] > last:
                    break
                best.append((float(time[i]), int(block.hash[i]), *(x[at[i] : at[i + 1]].tobytes() for x in (block.bucket, block.value))))
            best = sorted(best)[:most]
        if best:
            yield pa.record_batch([pa.array(x) for x in zip(*best)], names=["time", "first", "bucket", "value"])

    return task


def _seeds(rows: DataFrame, topics: int) -> np.ndarray:
    c, most = np.zeros((0, DIMS)), 4 * topics
    while len(c) < topics:
        before = c
        for r in rows.mapInArrow(_race(before, most), "time double, first long, bucket binary, value binary").orderBy("time", "first", "bucket", "value").limit(most).collect():
            x = np.zeros((1, DIMS))
            x[0, np.frombuffer(r.bucket, np.uint16)] = np.frombuffer(r.value, Block.TYPES["value"])
            far = _far(x @ c.T)[0]
            if len(c) < topics and far > LEAST and _chance(np.array([r.first]), -1 - len(before))[0] * _far(x @ before.T)[0] < far:
                c = np.concatenate([c, _scaled(x)])
        if len(c) == len(before):
            break
    return c


def fit(docs: DataFrame, topics: int = TOPICS, sample: int | None = None) -> Topics:
    """Of all rows of docs (doc_id, text). sample: of that many, those of smallest hash, only where a caller asks for it."""
    prepare(docs.sparkSession)
    texts = docs.select(F.xxhash64("doc_id", "text").alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    counted = stored((texts if sample is None else texts.orderBy("hash", "text").limit(sample)).mapInArrow(_counted, STORED), "counts")
    found = _summed(counted, DIMS + 1, _documents, Block.COUNTS)
    idf = np.log((found[DIMS] + 1) / (found[:DIMS] + 1)) + 1e-6
    rows = stored(counted.mapInArrow(lambda it: (b.vectors(idf).packed() for b in Block.all(it, Block.COUNTS)), STORED), "vectors")
    c = _seeds(rows, topics)
    for _ in range(ROUNDS if len(c) else 0):
        sums = _summed(rows, c.size, _nearest(c)).reshape(c.shape)
        new = np.where(sums.any(axis=1, keepdims=True), _scaled(sums), c)
        if np.array_equal(new, c):
            break
        c = new
    discard(counted, rows)
    return Topics(idf, c)


FORM = T.StructType().add("n_tokens", "long").add("topic", "string")


def _reader(topics: Topics):
    names = np.array([f"t{i}" for i in range(len(topics.centroids))] or ["none"], object)

    def run(texts: pd.Series) -> pd.DataFrame:
        out = [pd.DataFrame({"n_tokens": np.zeros(0, np.int64), "topic": np.zeros(0, object)})]
        for n, cell, tf in counts(pa.array(texts, pa.binary())):
            best = np.zeros(len(n), np.int64)
            if len(topics.centroids):
                block = Block(np.zeros(0), np.bincount(cell // DIMS, minlength=len(n)), cell % DIMS, tf)
                best = block.vectors(topics.idf).products(topics.centroids).argmax(axis=1)
            out.append(pd.DataFrame({"n_tokens": n, "topic": np.where(n > 0, names[best], "none")}))
        return pd.concat(out, ignore_index=True)

    return run


def read(docs: DataFrame, topics: Topics) -> DataFrame:
    """docs with topic and n_tokens, the number of words."""
    prepare(docs.sparkSession)
    own = docs.drop(*FORM.names)
    done = fresh("done", own)
    return own.withColumn(done, F.pandas_udf(_reader(topics), FORM)(F.coalesce("text", F.lit("")).cast("binary"))).select(*own.columns, f"{done}.topic", f"{done}.n_tokens")
