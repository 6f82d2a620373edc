"""Approximate nearest neighbours by cross-polytope hashing.

A vector is hashed in each table by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) to the
nearest of the signed axes; with more rows by several rotations, of the last of which only some axes count, so that buckets keep to about
PER_BUCKET rows. Every vector is indexed in all tables; a query probes in each table the joint axes that its rotated vectors
point at most (least sum of squared distances to the nearest). Candidates of a bucket are scored exactly, in double precision, and the best of each
bucket go on, those with equal scores by smallest id. Directions alone are hashed,
whatever the norms; a sample of queries is compared with all rows first, and its true neighbours, found by inner product, tell how many probes it
takes to meet a share `recall` of them. Where so many probes would move more rows than a comparison with all rows, and for queries with
fewer than k candidates found, all rows are compared, in blocks.

Equal vectors are one class: hashed, probed and scored once, with the k + 1 smallest ids as members, which is all that an answer
can hold. A bucket is cut into parts of about `chunk` classes; a task holds one part and streams the queries past it.

Defined results: vectors null, zero, empty or with null or non-finite components take no part, neither do rows with a null id. Rows
equal in id and vector count once. A query is not compared with rows of its own id. Ties go to the smaller id. Vectors of different lengths
have no inner product and do not meet. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_hash, partitions, prepare, stored

#: Probes are at least PROBES, and as many as RECALL takes on SAMPLE query classes.
TABLES, PROBES, SEED, RECALL, SAMPLE, PER_BUCKET = 16, 8, 11, 0.95, 128, 256
#: Probes in a table that are considered, at most, and rows and joint axes that are sorted at a time.
MOST_PROBES, AT_ONCE = 4096, 1 << 22
#: Found rows that a task holds before it keeps each query's best only.
HELD = 400_000
#: Columns of both sides of a bucket, but for the vector; query rows sort behind the bucket's classes.
ROW = "bucket long, part int, is_query boolean, h1 long, h2 long, least long"


def valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """x, padded to a power of two, under the table's pseudo-rotation."""
    n = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    for signs in np.random.Generator(np.random.PCG64(SEED + table)).integers(0, 2, (3, n)) * 2.0 - 1:
        x = hadamard(x * signs)
    return x


def directions(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def levels(d: int, n: int, per_bucket: int) -> list[int]:
    """Axes of each rotation that count, for n vectors of d dimensions."""
    full = 1 << max(0, (d - 1).bit_length())
    out, buckets = [full], 2 * full
    while out[-1] == full:
        fit = [w for w in (1 << i for i in range(1, full.bit_length())) if buckets * 2 * w * per_bucket <= n]
        if not fit:
            break
        out.append(fit[-1])
        buckets *= 2 * fit[-1]
    return out


def axes(x: np.ndarray, table: int, probes: int, widths: list[int]) -> np.ndarray:
    """The nearest joint axes, nearest first: a number with a digit for each rotation, 2 * axis + (1 for the positive end). Without rotations 0."""
    if not widths:
        return np.zeros((len(x), 1), np.int64)
    step = max(1, AT_ONCE // (min(probes, 2 * widths[0]) * 2 * widths[0]))
    return np.concatenate([_axes(x[i : i + step], table, probes, widths) for i in range(0, len(x), step)] or [np.zeros((0, 1), np.int64)])


def _axes(x: np.ndarray, table: int, probes: int, widths: list[int]) -> np.ndarray:
    code, total = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for level, w in enumerate(widths):
        r = rotated(x, table + 1000 * level)[:, :w]
        both = np.stack([-r, r], axis=2).reshape(len(r), -1)
        total = (total[:, :, None] + ((both.max(axis=1, keepdims=True) - both) ** 2)[:, None, :]).reshape(len(r), -1)
        code = (code[:, :, None] * (2 * w) + np.arange(2 * w)).reshape(len(r), -1)
        order = np.argsort(total, axis=1, kind="stable")[:, :probes]  # a joint axis among the nearest has a beginning among the nearest
        code, total = (np.take_along_axis(y, order, 1) for y in (code, total))
    return code


def _vectors(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length that occurs."""
    size = col.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        flat = col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, flat.reshape(len(rows), d)


def _hashed(tables: int, probes: int, widths: dict[int, list[int]], is_query: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            h1, h2, least = (batch.column(k).to_numpy() for k in ("h1", "h2", "least"))
            for rows, x in _vectors(batch.column("v")):
                unit = directions(x.astype(np.float64))
                for t in range(tables):
                    key = axes(unit, t, probes, widths.get(x.shape[1], []))
                    n = key.shape[1]
                    bucket = (np.int64(x.shape[1]) << np.int64(40)) + (np.int64(t) << np.int64(32)) + key.ravel()
                    own = np.repeat(rows, n)
                    v = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * x.shape[1], pa.int32()), pa.array(np.repeat(x, n, axis=0).ravel()))
                    cols = [pa.array(bucket), pa.array(np.zeros(len(own), np.int32)), pa.array(np.full(len(own), is_query)), pa.array(h1[own]), pa.array(h2[own]), pa.array(least[own]), v]
                    yield pa.record_batch(cols, names=["bucket", "part", "is_query", "h1", "h2", "least", "v"])

    return run


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in one order whatever the block."""
    return np.einsum("ij,ij->i", q, x)


def _chosen(v: np.ndarray, x: np.ndarray, least: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of v, row of x, exact product): for each v the `most` best of x, equal products by `least`."""
    score = v @ x.T  # in an order of addition of its own
    n = min(most, len(x))
    slack = 1e-10 * np.linalg.norm(v, axis=1) * np.linalg.norm(x, axis=1).max()
    q, c = np.nonzero(score >= (-np.partition(-score, n - 1, axis=1)[:, n - 1] - slack)[:, None])
    got = np.concatenate([exact(v[q[i : i + 50_000]], x[c[i : i + 50_000]]) for i in range(0, len(q), 50_000)])
    order = np.lexsort((least[c], -got, q))
    q, c, got = q[order], c[order], got[order]
    at = np.searchsorted(q, np.arange(len(v)))
    keep = np.arange(len(q)) - at[q] < n
    return q[keep], c[keep], got[keep]


def _pruned(rows: list[list[np.ndarray]], most: int) -> list[np.ndarray]:
    """q1, q2, c1, c2, least, score: each query's best classes, each class once."""
    cols = [np.concatenate(x) for x in zip(*rows)]
    o = np.lexsort(cols[3::-1])
    cols = [x[o] for x in cols]
    cols = [x[np.append(True, np.logical_or.reduce([y[1:] != y[:-1] for y in cols[:4]]))] for x in cols]
    o = np.lexsort((cols[4], -cols[5], cols[1], cols[0]))
    cols = [x[o] for x in cols]
    turn = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
    at = np.flatnonzero(turn)
    rank = np.arange(len(turn)) - np.repeat(at, np.diff(np.append(at, len(turn))))
    return [x[rank < most] for x in cols]


def _best(k: int):
    most = k + 8

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        place, parts, x, ids = None, [], None, None
        for batch in it:
            bucket, part = (batch.column(c).to_numpy() for c in ("bucket", "part"))
            query = batch.column("is_query").to_numpy(zero_copy_only=False)
            h = np.stack([batch.column(c).to_numpy() for c in ("h1", "h2", "least")], axis=1)
            turn = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]) | (query[1:] != query[:-1])))
            for a, b in zip(turn, np.append(turn[1:], len(bucket))):
                here = (bucket[a], part[a])
                if here != place:
                    place, parts, x = here, [], None
                v = batch.column("v").slice(a, b - a).flatten().to_numpy().reshape(b - a, -1).astype(np.float64)
                if not query[a]:
                    parts.append((v, h[a:b]))
                    continue
                if not parts:
                    continue
                if x is None:
                    x, ids = (np.concatenate(y) for y in zip(*parts))
                q, c, score = _chosen(v, x, ids[:, 2], most)
                yield [h[a:b][q, 0], h[a:b][q, 1], ids[c, 0], ids[c, 1], ids[c, 2], score]

    def out(rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(y) for y in rows], names=["q1", "q2", "c1", "c2", "least", "score"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rows in found(it):
            held.append(rows)
            n += len(rows[0])
            if n > HELD:
                held = [_pruned(held, most)]
                n = len(held[0][0])
                if n > HELD // 2:  # as many queries: the rest is for the grouping that follows
                    yield out(held[0])
                    held, n = [], 0
        if held:
            yield out(_pruned(held, most))

    return run


def _search(index: DataFrame, asked: DataFrame, k: int, tables: int, probes: int, chunk: int, widths: dict[int, list[int]]) -> DataFrame:
    """q1, q2, c1, c2, score: the best classes of each query class."""
    spark = index.sparkSession
    form = f"{ROW}, v {dict(index.dtypes)['v']}"
    rows = index.mapInArrow(_hashed(tables, 1, widths, False), form)
    ask = asked.mapInArrow(_hashed(tables, probes, widths, True), form)
    parts = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
    if all(len(w) < 2 for w in widths.values()):  # at most tables x 2 x dimensions buckets; of joint axes as many as the rows allow
        parts = F.broadcast(parts)
    rows = rows.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("h1", "h2"), F.col("parts")).cast("int")).drop("parts")
    ask = ask.join(parts, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = rows.unionByName(ask).repartition(partitions(spark), "bucket", "part").sortWithinPartitions("bucket", "part", "is_query").mapInArrow(_best(k), "q1 long, q2 long, c1 long, c2 long, least long, score double")
    found = met.groupBy("q1", "q2", "c1", "c2", "least").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "least")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).select("q1", "q2", "c1", "c2", "score")


def _nearest(sample: list[np.ndarray], most: int):
    """The task's best `most` classes for each vector of sample."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[np.ndarray]] = {}
        for batch in it:
            h1, h2, copies = (batch.column(k).to_numpy() for k in ("h1", "h2", "copies"))
            for rows, x in _vectors(batch.column("v")):
                for q, v in enumerate(sample):
                    if len(v) != x.shape[1]:
                        continue
                    score = x.astype(np.float64) @ v
                    top = np.argpartition(-score, most - 1)[:most] if len(score) > most else np.arange(len(score))
                    new = [score[top], h1[rows[top]], h2[rows[top]], copies[rows[top]], x[top].astype(np.float64)]
                    if q in best:
                        new = [np.concatenate(y) for y in zip(best[q], new)]
                        top = np.argsort(-new[0], kind="stable")[:most]
                        new = [y[top] for y in new]
                    best[q] = new
        for q, (score, *cols, x) in best.items():
            yield pa.record_batch([pa.array(np.full(len(score), q, np.int32)), pa.array(score), *map(pa.array, cols), pa.array(list(x), pa.list_(pa.float64()))], names=["q", "score", "h1", "h2", "copies", "v"])

    return run


def fitted(index: DataFrame, asked: DataFrame, k: int, tables: int, probes: int, per_bucket: int, chunk: int) -> tuple[int, int, dict[int, list[int]]]:
    """(tables, probes, axes that count by length of vectors) by which the sample meets a share RECALL of its answers: probes as given or more; or
    no axes, which compares all rows, where that moves fewer rows. So are compared vectors of other lengths than the 1,000 most frequent."""
    sizes = {r.d: r.n for r in index.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1000).collect()}
    widths = {d: levels(d, n, per_bucket) for d, n in sizes.items()}
    sample = asked.orderBy("h1", "h2").limit(SAMPLE).collect()
    found = index.mapInArrow(_nearest([np.array(r.v, float) for r in sample], k + 1), "q int, score double, h1 long, h2 long, copies long, v array<double>")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "h1", "h2")
    near: dict[int, list] = {}
    for r in sorted(found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).collect(), key=lambda r: (r.q, r.n)):
        near.setdefault(r.q, []).append(r)
    depth, weight, whole = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for q, rows in near.items():
        copies = np.array([r.copies - ((r.h1, r.h2) == (sample[q].h1, sample[q].h2)) for r in rows])
        least, x, v = np.full(len(rows), 1 << 30), directions(np.array([r.v for r in rows], float)), directions(np.array([sample[q].v], float))
        d = v.shape[1]
        whole = max(whole, ceil(sizes[d] / chunk))
        for t in range(tables):
            probed = axes(v, t, MOST_PROBES, widths[d])[0]
            same = axes(x, t, 1, widths[d]) == probed
            least = np.minimum(least, np.where(same.any(axis=1), same.argmax(axis=1), 1 << 30))
        depth.append(np.minimum(least, MOST_PROBES))
        weight.append(np.diff(np.minimum(np.cumsum(np.append(0, copies)), k)))
    depth, weight = np.concatenate(depth), np.concatenate(weight)
    met = np.cumsum(np.bincount(depth, weight, MOST_PROBES + 1))
    needed = 1 + int(np.searchsorted(met, RECALL * weight.sum())) if weight.sum() else probes
    if needed <= probes:
        return tables, probes, widths
    return (tables, needed, widths) if needed <= MOST_PROBES and tables * needed < whole else (1, 1, {})


def search(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES, chunk: int = 4096, per_bucket: int = PER_BUCKET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of vectors (vec_id, v) for which is_query holds."""
    spark = vectors.sparkSession
    prepare(spark, 4096)
    v = F.col("v") if dict(vectors.dtypes)["v"] == "array<float>" else F.col("v").cast("array<double>")  # single precision takes half the room
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), is_query.alias("asks")).filter(F.col("vec_id").isNotNull() & valid(F.col("v")))
    every = stored(every.select("vec_id", "v", "asks", *(c.alias(n) for c, n in zip(key_hash(F.col("v")), ("h1", "h2")))), "vectors")
    ids = every.select("vec_id", "h1", "h2").distinct()
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    members = stored(ids.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n"), "members")
    firsts = members.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    # vectors without ids repeated: the row of the smallest id
    index = stored(every.join(firsts, ["h1", "h2", "vec_id"]).dropDuplicates(["h1", "h2"]).select("h1", "h2", F.col("vec_id").alias("least"), "v", "copies"), "classes")
    asking = every.filter("asks").select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    asked = index.join(asking.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    tables, probes, widths = fitted(index, asked, k, tables, probes, per_bucket, chunk)
    top = stored(_search(index, asked, k, tables, probes, chunk, widths), "top")

    def answers(top: DataFrame) -> DataFrame:
        near = top.join(members.withColumnsRenamed({"h1": "c1", "h2": "c2"}), ["c1", "c2"])
        order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
        near = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), "vec_id", "score")
        best = asking.join(near, ["h1", "h2"]).filter(F.col("query_id") != F.col("vec_id"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = stored(answers(top), "answers")
    few = asking.join(found.filter(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    again = asked.join(few.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    if few.isEmpty():
        return found
    whole = answers(_search(index, again, k, 1, 1, chunk, {})).join(few.select("query_id"), "query_id", "left_semi")
    return found.join(few.select("query_id"), "query_id", "left_anti").unionByName(whole)
