"""SimHash near-duplicates by pivot distance tables.

Equal fingerprints are folded first, so copies cost nothing. Distinct fingerprints are dealt out by m blocks of bits, by every m - 4 of
them: two fingerprints that differ in at most four bits agree in m - 4 blocks at least, so they meet in some bucket. m is 5, and more only where
there are so many fingerprints that buckets would hold more than a few thousand; no pair within the radius is lost either way. Inside a
bucket the distances to the reference fingerprints (pivots) are laid out as a table sorted by the first pivot; a pair goes on only
while no coordinate differs by more than the radius (triangle inequality), and survivors are verified by their true distance. Only
links that join two groups not yet joined in that bucket come out: at most one fewer than its rows, however many pairs it has.
Buckets of more than `chunk` fingerprints are cut into parts and each two parts meet in a task of their own.

Components come from alternating large-star and small-star steps, each written to the shared folder.

Defined results: a null text is like an empty one, fingerprint zero. Rows with equal fingerprints share a component; a component's id
is its smallest doc_id that isn't null, null if it has none. Repeated rows come out as often as they went in. An empty table gives an
empty table.

near_dedup() has parameters of its own: texts are near copies if the sets of their runs of five words (ASCII case folded) have a
Jaccard similarity of 0.8 or more; a text of one to four words is one run, texts without words are alike. Equal sets are folded. The others have
fingerprints of 256 bits, each bit the majority of that bit in the hashes of all runs, and are dealt out by samples of these bits: as many samples as leave
a pair at 0.8 a chance of MISS to meet nowhere. In a bucket sets are sorted by their distance to the pivot, which is the empty set
(their size); a pair goes on only while that differs by no more than 0.8 allows, and if the fingerprints differ in NEAR_RADIUS bits at most. Random
fingerprints as pivots would drop nothing here: their distances have a spread of 11, far below the radius. Inside each connected
group of such candidates components are found by exact similarity (of 64-bit hashes of runs). Buckets of more than `bucket` and groups of more than `chunk` sets
are cut into parts as above. It keeps of each component the row with the smallest (doc_id, nulls last; hash of the text), once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import discard, fresh, partitions, prepare, stored

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints in a bucket, if evenly spread, beyond which there are more blocks.
BUCKET = 2048
PIVOTS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 16, dtype=np.uint64, endpoint=False)
BLOCK = 1 << 16
#: near_dedup(): least similarity, words in a shingle, bits of a fingerprint, share of them that differ at the least similarity (at most, ties of small sets
#: included), most that may, chance that such a pair meets in no bucket, sets in a bucket if evenly spread.
NEAR, NEAR_SHINGLE, NEAR_BITS, DIFFER, NEAR_RADIUS, MISS, NEAR_BUCKET = 0.8, 5, 256, 0.163, 76, 3e-6, 1024
WORDS = np.random.Generator(np.random.PCG64(23)).integers(0, 1 << 63, (NEAR_BITS // 64, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
        return hashes[0]
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    n, ones = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        j = min(n, i + BLOCK)
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start[i:j].tolist(), end[i + SHINGLE - 1 : j + SHINGLE - 1].tolist())), np.uint64, j - i)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((fingerprint(t or b"") for t in texts), np.uint64, len(texts)).view(np.int64))


def fingerprint_of(text: Column) -> Column:
    """The fingerprint as a signed 64-bit integer."""
    return _fingerprints(F.coalesce(text, F.lit("")).cast("binary"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _swept(task: np.ndarray, ahead, near) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal task, enough to join what is joined: pairs of positions. ahead(i, j): which j are still within reach of i, fewer as
    j grows; near(i, j): which pairs link."""
    size = len(task)
    turn = np.ones(size, bool)
    turn[1:] = task[1:] != task[:-1]
    at = np.flatnonzero(turn)
    stop = np.repeat(np.append(at[1:], size), np.diff(np.append(at, size)))
    run = np.cumsum(turn) - 1
    groups = np.bincount(run)  # in each run, not yet joined
    root = np.arange(size)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i, d = np.arange(size), 0
    while len(i):
        d += 1
        i = i[i + d < stop[i]]
        i = i[ahead(i, i + d) & (groups[run[i]] > 1)]
        j = i + d
        go = root[i] != root[j]
        x, y = i[go], j[go]
        ok = near(x, y)
        x, y = x[ok], y[ok]
        if not len(x):
            continue
        used = []
        for p, q in zip(x.tolist(), y.tolist()):
            while root[p] != p:
                root[p] = p = root[root[p]]
            while root[q] != q:
                root[q] = q = root[root[q]]
            used.append(p != q)
            root[max(p, q)] = min(p, q)
        used = np.array(used)
        np.subtract.at(groups, run[x[used]], 1)
        a.append(x[used])
        b.append(y[used])
        while (deep := root[root]).tobytes() != root.tobytes():
            root = deep
    return np.concatenate(a), np.concatenate(b)


def _linked(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    fp = rows["fp"].view(np.uint64)
    table = np.stack([np.bitwise_count(fp ^ p) for p in PIVOTS], axis=1).astype(np.int8)
    order = np.lexsort((table[:, 0], rows["task"]))
    fp, table = fp[order], table[order]

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = np.abs(table[x] - table[y]).max(axis=1, initial=0) <= RADIUS
        ok[ok] = np.bitwise_count(fp[x[ok]] ^ fp[y[ok]]) <= RADIUS
        return ok

    a, b = _swept(rows["task"][order], lambda i, j: table[j, 0] - table[i, 0] <= RADIUS, near)
    return order[a], order[b]


def _near_linked(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((rows["n"], rows["task"]))
    n, fp = rows["n"][order], np.stack([rows[f"f{k}"].view(np.uint64)[order] for k in range(len(WORDS))])

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(f[x] ^ f[y]).astype(np.int64) for f in fp) <= NEAR_RADIUS

    a, b = _swept(rows["task"][order], lambda i, j: n[i] >= NEAR * n[j] - 1e-6, near)
    return order[a], order[b]


def _by_task(columns: list[str], linked):
    """A function for mapInArrow: links (a, b), values of the first column, within runs of equal task."""

    def out(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        a, b = linked(rows)
        return pa.record_batch([pa.array(rows[columns[0]][a]), pa.array(rows[columns[0]][b])], names=["a", "b"])

    def links_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        count = 0
        for batch in it:
            held.append({k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("task", *columns)})
            count += batch.num_rows
            if count < BLOCK:
                continue
            rows = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
            cut = int(np.searchsorted(rows["task"], rows["task"][-1]))
            if cut:
                yield out({k: v[:cut] for k, v in rows.items()})
            held, count = [{k: v[cut:] for k, v in rows.items()}], count - cut
        if count:
            yield out({k: np.concatenate([x[k] for x in held]) for k in held[0]})

    return links_of


def blocks(n: int, bucket: int = BUCKET) -> list[int]:
    """Sizes of the blocks of bits for n fingerprints."""
    for m in range(RADIUS + 1, 17):
        sizes = [64 // m + (i < 64 % m) for i in range(m)]
        if bucket << sum(sizes[RADIUS:]) >= n:
            break
    return sizes


def links(fps: DataFrame, chunk: int = 4096, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp), enough to connect each component. Rows of fps must be distinct."""
    sizes = blocks(fps.count(), bucket)
    shift = np.cumsum([0, *sizes])

    def bits(k: int) -> Column:
        return F.shiftrightunsigned("fp", int(shift[k])).bitwiseAND(F.lit((1 << sizes[k]) - 1))

    def key(n: int, some: tuple[int, ...]) -> Column:
        out = F.lit(n).cast("long")
        for k in some:
            out = F.shiftleft(out, sizes[k]).bitwiseOR(bits(k))
        return out

    keys = F.array(*(key(n, some) for n, some in enumerate(combinations(range(len(sizes)), len(sizes) - RADIUS))))
    keyed = fps.select("fp", F.explode(keys).alias("key"))
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = keyed.join(full, "key").select("fp", "key", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    task = F.when((F.col("part") == 0) & (F.col("other") == 0), F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    by_task = dealt.select("fp", task.alias("task")).repartition(partitions(fps.sparkSession), "task").sortWithinPartitions("task")
    return by_task.mapInArrow(_by_task(["fp"], _linked), "a long, b long")


def _forest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task as stars around the smallest node; memory as the task's own edges."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.setdefault(x, x)) != x:
            root[x] = x = root[p]
        return x

    for batch in it:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    for i in range(0, len(nodes), BLOCK):
        some = nodes[i : i + BLOCK]
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, label (the smallest node of its component) for the nodes of edges (a, b)."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())

    star = stored(edges.mapInArrow(_forest, "a long, b long"), "forest")  # a > b
    now = mark(star)
    for _ in range(most_rounds):
        if not now[0]:
            break
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are stored: a join of two plain tables can split the rows of a hub, one with a grouping below cannot
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.distinct(), "large")
        small_min = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(small_min, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, star = star, stored(small.unionByName(small_min.select("a", F.col("m").alias("b"))).filter(F.col("a") != F.col("b")).distinct(), "star")
        discard(old, least, large, small_min)
        before, now = now, mark(star)
        if before == now:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    labels = star.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _slim(docs: DataFrame) -> DataFrame:
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), fingerprint_of(F.col("text")).alias("fp")), "fingerprints")


def groups(slim: DataFrame, chunk: int = 4096) -> DataFrame:
    """fp, label, component_id for each distinct fingerprint of slim (doc_id, fp)."""
    each = stored(slim.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    labels = components(links(each.select("fp"), chunk))
    labelled = each.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("label", "fp").alias("label"))
    ids = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(ids, "label").select("fp", "label", "component_id")


def simhash_groups(docs: DataFrame, chunk: int = 4096) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    slim = _slim(docs)
    return slim.join(groups(slim, chunk), "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def _shingled(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of NEAR_SHINGLE words; a text of fewer words is one run."""
    for _, _, data, at in W.chunks(texts):
        words = W.split(data, at, fold=True)
        h = words.hashes()
        runs = W.rolling(h, NEAR_SHINGLE)
        n = np.diff(words.first)
        short = W.spans(h, words.first[:-1], words.first[1:], 0x9E6C63D0876A9A47)
        for k, (a, m) in enumerate(zip(words.first.tolist(), n.tolist())):
            yield np.unique(runs[a : a + m - NEAR_SHINGLE + 1]) if m >= NEAR_SHINGLE else short[k : k + min(m, 1)]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, W.U), *rows]).view(np.int64)))


def samples(sets: int) -> np.ndarray:
    """Bits that make the keys of each table, for so many sets: the more sets, the more bits, and the more tables."""
    bits = max(8, int(np.ceil(np.log2(max(sets, 1) / NEAR_BUCKET))))
    d = np.arange(NEAR_BITS + 1)
    log = np.concatenate([[0], np.cumsum(np.log(d[1:]))])
    weight = np.exp(log[-1] - log - log[::-1] + d * np.log(DIFFER) + (NEAR_BITS - d) * np.log(1 - DIFFER))
    meet = np.prod([np.clip(NEAR_BITS - d - i, 0, None) / (NEAR_BITS - i) for i in range(bits)], axis=0)
    tables = 1
    while (weight * (1 - meet) ** tables).sum() > MISS:
        tables += 1
    rng = np.random.Generator(np.random.PCG64(29))
    return np.stack([rng.permutation(NEAR_BITS)[:bits] for _ in range(tables)])


def majorities(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits of the fingerprints of sets: rows of NEAR_BITS. at, sizes: where each set lies in flat."""
    words = W.mix(flat * WORDS)
    # sums of the eight bits of every byte in turn, in bytes: of 255 hashes at most
    pieces = -(-sizes // 255)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    start = np.repeat(at, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    each = W.U(0x0101010101010101)
    sums = np.stack([np.add.reduceat((words >> W.U(j)) & each, start, axis=1) for j in range(8)])
    ones = np.add.reduceat(sums.view(np.uint8).reshape(8, len(WORDS), len(start), 8).transpose(2, 0, 1, 3).reshape(len(start), NEAR_BITS).astype(np.int64), first, axis=0)
    # one run more that all sets of four and more share: with it, no set of so few is near a tie that its near copies are not near
    own = np.arange(NEAR_BITS) % 2
    more = (sizes >= 4)[:, None]
    return 2 * (ones + own * more) > sizes[:, None] + more


def _signatures(bits: np.ndarray):
    """sid (hash of the set, 0 if empty), n (its size), fp (fingerprint) and keys (one for each table) of texts."""
    scale = 1 << np.arange(bits.shape[1])
    table = np.arange(len(bits)) << bits.shape[1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sid, n, fp, keys, held = [], [], [], [], []

            def flush() -> None:
                some = [x for x in held if len(x)]
                out = iter(())
                if some:
                    sizes = np.array([len(x) for x in some])
                    flat, at = np.concatenate(some), np.cumsum([0, *sizes[:-1]])
                    ids = W.mix(np.add.reduceat(W.mix(flat ^ W.U(SEED)), at))
                    ones = majorities(flat, at, sizes)
                    out = zip(ids, np.packbits(ones, axis=1).view(W.U), ones[:, bits] @ scale + table)
                for x in held:
                    i, f, k = next(out) if len(x) else (W.U(0), np.zeros(len(WORDS), W.U), np.zeros(0, np.int64))
                    sid.append(i)
                    n.append(len(x))
                    fp.append(f)
                    keys.append(k.view(W.U))
                held.clear()

            for x in _shingled(batch.column("text")):
                held.append(x)
                if sum(map(len, held)) > BLOCK or len(held) == 64:
                    flush()
            flush()
            cols = [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(sid, W.U).view(np.int64)), pa.array(n, pa.int64()), _lists(fp), _lists(keys)]
            yield pa.record_batch(cols, names=["doc_id", "text_hash", "sid", "n", "fp", "keys"])

    return run


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        cols = [batch.column("doc_id"), batch.column("text_hash"), _lists(list(_shingled(batch.column("text"))))]
        yield pa.record_batch(cols, names=["doc_id", "text_hash", "shingles"])


def joined(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of places with Jaccard similarity NEAR or more that connect each component; sets hold distinct values, none is empty."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    first = np.cumsum([0, *size])
    _, code = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    mark, fresh_ones, out = np.zeros(code.max() + 1, bool), np.ones(len(size), bool), []
    for start in range(len(size)):
        if not fresh_ones[start]:
            continue
        fresh_ones[start] = False
        queue = [start]
        while queue and fresh_ones.any():
            i = queue.pop()
            low, high = np.searchsorted(size, NEAR * size[i] - 1e-6), np.searchsorted(size, size[i] / NEAR + 1e-6, "right")
            if not fresh_ones[low:high].any():
                continue
            own = code[first[i] : first[i + 1]]
            mark[own] = True
            shared = np.add.reduceat(mark[code[first[low] : first[high]]], first[low:high] - first[low], dtype=np.int64)
            mark[own] = False
            near = low + np.flatnonzero((shared >= NEAR * (size[low:high] + size[i] - shared) - 1e-9) & fresh_ones[low:high])
            fresh_ones[near] = False
            queue += near.tolist()
            out += [(int(order[i]), int(order[j])) for j in near]
    return out


def _near_links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, ids, sets = None, [], []

    def out() -> pa.RecordBatch:
        pairs = joined(sets) if len(sets) > 1 else []
        return pa.record_batch([pa.array([ids[k[side]] for k in pairs], pa.int64()) for side in (0, 1)], names=["a", "b"])

    for batch in it:
        shingles = batch.column("shingles")
        for k, (t, sid) in enumerate(zip(batch.column("task").to_pylist(), batch.column("sid").to_pylist())):
            if t != task:
                yield out()
                task, ids, sets = t, [], []
            ids.append(sid)
            sets.append(shingles[k].values.to_numpy())
    yield out()


def near_links(docs: DataFrame, each: DataFrame, chunk: int, most: int = 1 << 19, bucket: int = 4096) -> DataFrame:
    """a, b: links between sets (sid) of similarity NEAR or more, enough to connect each component. each: one row (sid, doc_id, text_hash, n, fp, keys) a set."""
    spark = docs.sparkSession
    full = each.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > bucket)
    full = stored(full.select("key", F.ceil(F.col("held") / bucket).cast("int").alias("parts")), "full")  # few: at most all keys' rows / bucket
    own = ["sid", "n", *(f"f{k}" for k in range(len(WORDS)))]
    keyed = each.select("sid", "n", *(F.col("fp")[k].alias(f"f{k}") for k in range(len(WORDS))), F.explode("keys").alias("key"))
    part = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    split = keyed.join(F.broadcast(full), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part)
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    task = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    met = split.select(*own, task.alias("task")).repartition(partitions(spark), "task").sortWithinPartitions("task")
    rough = components(met.mapInArrow(_by_task(own, _near_linked), "a long, b long"))
    members = stored(rough.withColumnRenamed("node", "sid").join(each.drop("keys", "fp"), "sid"), "candidates")
    # shingles are made anew for candidates alone; a table of 2^24 bits keeps most other texts from the shuffle
    word, bit = F.shiftrightunsigned("text_hash", 46), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("text_hash", 40).bitwiseAND(63).cast("int"))
    some = members.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = texts.withColumn("word", word).join(F.broadcast(some), "word").filter(F.col("bits").bitwiseAND(bit) != 0).select("doc_id", "text_hash", "text")
    sets = texts.mapInArrow(_sets, "doc_id long, text_hash long, shingles array<long>").withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    sets = stored(sets.join(members, (F.col("h") == F.col("text_hash")) & F.col("d").eqNullSafe(F.col("doc_id"))).select("sid", "label", "shingles"), "sets")
    full = members.groupBy("label").agg(F.ceil(F.greatest(F.count(F.lit(1)) / chunk, F.sum("n") / most)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    dealt = sets.join(full, "label").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.filter((F.col("part") != F.col("other")) | (F.col("parts") == 1))
    task = F.xxhash64("label", F.least("part", "other"), F.greatest("part", "other"))
    by_task = dealt.select("sid", "shingles", task.alias("task")).repartition(partitions(spark), "task").sortWithinPartitions("task")
    return by_task.mapInArrow(_near_links, "a long, b long")


def near_dedup(docs: DataFrame, chunk: int = 1024) -> DataFrame:
    """The rows of docs that stay, one for each component of similar texts; columns as they were."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    slim = slim.mapInArrow(_signatures(samples(docs.count())), "doc_id long, text_hash long, sid long, n long, fp array<long>, keys array<long>")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n", "fp", "keys")
    each = stored(slim.groupBy("sid").agg(F.min(row).alias("row")).select("sid", "row.*"), "distinct")
    labels = components(near_links(docs, each.drop("none"), chunk)).withColumnRenamed("node", "sid")
    labelled = each.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    best = labelled.groupBy("label").agg(F.min(F.struct("none", "doc_id", "text_hash")).alias("best"))
    key, of = fresh("key", docs), fresh("of", docs)

    def named(*cols: Column) -> Column:
        return F.struct(cols[0].alias("a"), cols[1].alias("b"))

    stay = best.select(named(F.col("best.doc_id"), F.col("best.text_hash")).alias(of))
    keyed = docs.withColumn(key, named(F.col("doc_id").cast("long"), F.xxhash64("text")))
    return keyed.join(stay, keyed[key].eqNullSafe(stay[of]), "left_semi").dropDuplicates([key]).drop(key)

