"""A bigram language model with interpolated modified Kneser-Ney smoothing, counted in Spark, memory-mapped by the workers.

Training scans the texts twice. The first scan counts words; the model's vocabulary is a sorted array of 64-bit word hashes, and a word's
place in it is its id. The second counts pairs (previous id, id), packed in 64 bits. Both pre-aggregate in each task and shuffle sorted,
packed arrays by key range; pairs of frequent words get ranges of their own, and several if need be. Each range becomes a part: sorted keys
and counts, written under a temporary name in the shared folder and renamed, so that a repeated task does no harm. Numbers of
continuations and of followers by count are dense arrays beside the vocabulary. Scoring maps the parts read-only; each lookup is a
search of sorted distinct keys.

The probability of word w after v, with c(vw) counted, N the number of distinct pairs and D the discounts by count:
  P(w|v) = (max(c(vw) - D, 0) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) P(w)) / c(v);   P(w|v) = P(w) if v was never seen
  P(w) = (max(N(w) - D', 0) + (D1' m1 + D2' m2 + D3' m3) / (V + 1)) / N
where the V + 1st outcome is every unknown word, so the probabilities add to one.

Defined results: words are runs of anything but [\\x20\\x09-\\x0D], A-Z folded; then comes one end token, which counts as a token and in V. A null text is
empty: the end token alone. Without training texts V is 0 and every score is 0. Repeated rows are counted and scored as often as they
occur; a null doc_id changes nothing. Other columns go through unchanged; `n_tokens`, `n_known`, `base_score` and `score` are replaced.

The shared folder must be mounted where executors run (file:), since workers map its files. Ids have 32 bits: a vocabulary of 2 ** 32 words or more is an
error, not a wrong model. Counts have 64 bits; of pairs, where nearly all are small, 16, and a list of the larger ones.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import fresh, new_path, partitions, prepare, stored

U = np.uint64
END = int(W.mix(np.array([1], U))[0])
#: Distinct keys that a task holds before it puts them out, and tokens that are looked up at a time.
HELD, AT_ONCE = 4_000_000, 500_000
#: Training tokens in a range of pairs, which a task holds at a time; fewer only as far as that makes no more ranges than shuffle partitions.
PER_RANGE, LEAST_PER_RANGE = 16_000_000, 100_000
NARROW = "uint16"
ROWS = "range int, keys binary, counts binary"


def pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def unpack(b: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(b: bytes, dtype: type) -> np.ndarray:
    return np.cumsum(unpack(b, dtype), dtype=dtype)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
    return k[first], np.add.reduceat(c, first) if len(first) else c


def tokens(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, row after the last, token hashes, where each row's tokens begin)."""
    for batch in it:
        for i, j, data, at in W.chunks(batch.column("text"), AT_ONCE * 8):
            words = W.split(data, at, fold=True)
            yield batch, i, j, np.insert(words.hashes(), words.first[1:], U(END)), words.first + np.arange(len(words.first))


class _Counter:
    def __init__(self, edges: np.ndarray):
        self.edges, self.keys, self.counts, self.n = edges, [], [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.n += len(k)
        if self.n > HELD:
            k, c = added(self.keys, self.counts)
            self.keys, self.counts, self.n = [k], [c], len(k)
            if self.n > HELD // 2:
                yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        k, c = added(self.keys, self.counts)
        self.keys, self.counts, self.n = [], [], 0
        cut = np.append(np.searchsorted(k, self.edges), len(k))
        for r in np.flatnonzero(np.diff(cut)):
            a, b = cut[r], cut[r + 1]
            yield pa.record_batch([pa.array([r], pa.int32()), pa.array([pack_sorted(k[a:b])], pa.binary()), pa.array([pack(c[a:b])], pa.binary())], names=["range", "keys", "counts"])


def _count_words(edges: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(edges)
        for *_, h, _ in tokens(it):
            yield from counter.add(h)
        yield from counter.out()

    return run


def _write(path: str, a: np.ndarray) -> None:
    tmp = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    a.tofile(tmp)
    os.replace(tmp, path)


def _merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return added([unpack_sorted(b, U) for b in pdf["keys"]], [unpack(b, np.int64) for b in pdf["counts"]])


@dataclass
class Model:
    """What workers need to open the parts. first and size have, for each part of the vocabulary and of the pairs, its least key and length."""

    path: str
    word_first: np.ndarray
    word_size: np.ndarray
    pair_first: np.ndarray
    pair_size: np.ndarray
    n: int = 0  # training tokens
    docs: int = 0
    discounts: tuple = (0.75, 0.75, 0.75)
    low_discounts: tuple = (0.75, 0.75, 0.75)
    start: tuple = (0, 0, 0)  # followers of the text's start, by count: 1, 2, more
    spread: tuple = (0, 0, 0)  # words by number of continuations: 1, 2, more
    pairs: int = 0
    narrow: str = NARROW  # type of pair counts; those that reach its end are listed apart
    word_ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self):
        self.word_ids = np.concatenate([[0], np.cumsum(self.word_size)]).astype(np.int64)

    @property
    def v(self) -> int:
        return int(self.word_ids[-1])


_open: dict[tuple[str, str, int], np.ndarray] = {}


def _part(path: str, name: str, i: int, dtype: type | str, width: int = 1) -> np.ndarray:
    if (key := (path, name, i)) not in _open:
        if len(_open) > 5000:
            _open.clear()
        a = np.memmap(f"{path}/{name}-{i:06}", dtype, "r")
        _open[key] = a.reshape(-1, width) if width > 1 else a
    return _open[key]


def _find(path: str, name: str, first: np.ndarray, size: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, place in it) for each of the sorted keys; place -1 where it isn't found."""
    part, place = np.zeros(len(keys), np.int64), np.full(len(keys), -1)
    if len(first):
        part = np.maximum(np.searchsorted(first, keys, "right") - 1, 0)
        for p in np.unique(part):
            a, z = np.searchsorted(part, [p, p + 1])
            if size[p]:
                known = _part(path, f"{name}-keys", p, U)
                at = np.minimum(np.searchsorted(known, keys[a:z]), size[p] - 1)
                place[a:z] = np.where(known[at] == keys[a:z], at, -1)
    return part, place


def _gather(path: str, name: str, part: np.ndarray, place: np.ndarray, dtype: type | str, width: int = 1) -> np.ndarray:
    out = np.zeros((len(part), width) if width > 1 else len(part), np.int64)
    for p in np.unique(part[place >= 0]):
        a, z = np.searchsorted(part, [p, p + 1])
        hit = np.flatnonzero(place[a:z] >= 0) + a
        out[hit] = _part(path, name, p, dtype, width)[place[hit]]
    return out


def _pair_counts(model: Model, part: np.ndarray, place: np.ndarray) -> np.ndarray:
    out = _gather(model.path, "pair-counts", part, place, model.narrow)
    most = np.iinfo(model.narrow).max
    for p in np.unique(part[out == most]):
        at, count = _part(model.path, "pair-large", p, np.int64).reshape(2, -1)
        hit = np.flatnonzero((part == p) & (out == most))
        out[hit] = count[np.searchsorted(at, place[hit])]
    return out


def _pair_keys(model: Model, h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """For each token its id (-1: unknown) and its predecessor's (V: the start); places of distinct tokens."""
    u, back = np.unique(h, return_inverse=True)
    part, place = _find(model.path, "word", model.word_first, model.word_size, u)
    ids = np.where(place >= 0, model.word_ids[part] + place, -1)[back]
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[begin[:-1]] = model.v
    return ids, before, back, (part, place)


def _count_pairs(model: Model, edges: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(edges)
        for *_, h, begin in tokens(it):
            ids, before, *_ = _pair_keys(model, h, begin)
            yield from counter.add((before.astype(U) << U(32)) | ids.astype(U))
        yield from counter.out()

    return run


WORD_PART = "range int, n long, tokens long, hot binary, hot_counts binary"


def _keep_words(path: str, share: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k, c = _merged(pdf)
        r = int(key[0])
        _write(f"{path}/word-keys-{r:06}", k)
        _write(f"{path}/word-counts-{r:06}", c)
        hot = np.flatnonzero(c >= share)
        return pd.DataFrame([(r, len(k), int(c.sum()), hot.astype(np.int64).tobytes(), c[hot].tobytes())], columns=["range", "n", "tokens", "hot", "hot_counts"])

    return run


PAIR_PART = "kind string, range int, n long, by_count array<long>, ids binary, a binary, b binary, c binary"


def _keep_pairs(model: Model):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k, c = _merged(pdf)
        r = int(key[0])
        _write(f"{model.path}/pair-keys-{r:06}", k)
        most = np.iinfo(model.narrow).max
        _write(f"{model.path}/pair-counts-{r:06}", np.minimum(c, most).astype(model.narrow))
        if len(large := np.flatnonzero(c >= most)):
            _write(f"{model.path}/pair-large-{r:06}", np.concatenate([large, c[large]]))
        rows = [("part", r, len(k), [int((c == i).sum()) for i in (1, 2, 3, 4)], b"", b"", b"", b"")]

        def dealt(kind: str, ids: np.ndarray, *values: np.ndarray) -> None:
            cut = np.searchsorted(ids, model.word_ids)
            for p in np.flatnonzero(np.diff(cut)):
                a, b = cut[p], cut[p + 1]
                packed = [pack(v[a:b].astype(np.uint32)) for v in values]
                rows.append((kind, int(p), 0, [], pack_sorted((ids[a:b] - model.word_ids[p]).astype(np.uint32)), *packed, *[b""] * (3 - len(values))))

        context = (k >> U(32)).astype(np.int64)
        at = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(k) else np.zeros(0, np.int64)
        ones, twos, more = (np.add.reduceat(x.astype(np.int64), at) if len(at) else at for x in (c == 1, c == 2, c > 2))
        head = context[at]
        rows += [("start", r, 0, [int(x[i]) for x in (ones, twos, more)], b"", b"", b"", b"") for i in np.flatnonzero(head == model.v)]
        dealt("context", head, ones, twos, more)
        word, times = np.unique((k & U(0xFFFFFFFF)).astype(np.int64), return_counts=True)
        dealt("word", word, times)
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PAIR_PART.split(", ")])

    return run


def _keep_dense(model: Model):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = int(key[0])
        n = int(model.word_size[p])
        after, follow = np.zeros(n, np.int64), np.zeros((n, 3), np.int64)
        for kind, ids, a, b, c in pdf[["kind", "ids", "a", "b", "c"]].itertuples(index=False):
            at = unpack_sorted(ids, np.uint32).astype(np.int64)
            if kind == "word":
                after[at] += unpack(a, np.uint32)
            else:
                for i, x in enumerate((a, b, c)):
                    follow[at, i] += unpack(x, np.uint32)
        _write(f"{model.path}/word-after-{p:06}", after.astype(np.uint32))
        _write(f"{model.path}/word-follow-{p:06}", follow.astype(np.uint32))
        return pd.DataFrame([[p, *(int((after == i).sum()) for i in (1, 2, 3, 4)), int((after > 0).sum()), int(after.sum())]], columns=["range", "n1", "n2", "n3", "n4", "any", "total"])

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from the numbers of keys counted 1 to 4 times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.75, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))


def _folder(spark: SparkSession) -> str:
    path = new_path(spark, "lm")
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"workers map the model's files, so spark.checkpoint.dir must be a mounted folder, not {path}")
    return path


def train(docs: DataFrame, narrow: str = NARROW) -> Model:
    """The model of the column text of docs."""
    spark = docs.sparkSession
    prepare(spark)
    path = _folder(spark)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark)
    edges = np.array([(i << 64) // n for i in range(n)], U)
    share = HELD / 8
    made = texts.mapInArrow(_count_words(edges), ROWS).groupBy("range").applyInPandas(_keep_words(path, share), WORD_PART)
    parts = {r["range"]: r for r in stored(made, "words").collect()}  # a row for each range
    if not parts:
        return Model(path, np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64))
    size = np.array([parts[r]["n"] if r in parts else 0 for r in range(n)])
    model = Model(path, edges, size, np.zeros(0, U), np.zeros(0, np.int64), n=sum(r["tokens"] for r in parts.values()), narrow=narrow)
    if model.v >= (1 << 32) - 1:
        raise ValueError("more distinct words than ids of 32 bits")
    r = int(np.searchsorted(edges, U(END), "right")) - 1
    place = int(np.searchsorted(_part(path, "word-keys", r, U), U(END)))
    model.docs = int(_part(path, "word-counts", r, np.int64)[place])
    n = max(ceil(model.n / PER_RANGE), min(n, ceil(model.n / LEAST_PER_RANGE)))
    # ranges of pairs: even in ids, and frequent words (which are few, since each has `share` tokens) apart
    v, most = model.v, max(1, model.n // n)
    hot = [(int(model.word_ids[p] + w), int(c)) for p, row in parts.items() for w, c in zip(np.frombuffer(row["hot"], np.int64), np.frombuffer(row["hot_counts"], np.int64))]
    cuts = {(v * i // n) << 32 for i in range(n)}
    for w, c in [*hot, (v, model.docs)]:
        cuts |= {(w << 32) | (v * i // max(1, ceil(c / most))) for i in range(max(1, ceil(c / most)))} | {(w + 1) << 32}
    cuts = np.array(sorted(cuts), U)
    kept = texts.mapInArrow(_count_pairs(model, cuts), ROWS).groupBy("range").applyInPandas(_keep_pairs(model), PAIR_PART)
    kept = stored(kept, "pairs")
    found = {row["range"]: row for row in kept.filter("kind = 'part'").select("range", "n", "by_count").collect()}
    model.pair_first, model.pair_size = cuts, np.array([found[i]["n"] if i in found else 0 for i in range(len(cuts))])
    model.pairs = int(model.pair_size.sum())
    model.discounts = discounts([sum(row["by_count"][i] for row in found.values()) for i in range(4)])
    starts = [row["by_count"] for row in kept.filter("kind = 'start'").select("by_count").collect()]
    model.start = tuple(sum(s[i] for s in starts) for i in range(3))
    dense = kept.filter("kind IN ('context', 'word')").groupBy("range").applyInPandas(_keep_dense(model), "range int, n1 long, n2 long, n3 long, n4 long, any long, total long")
    m = stored(dense, "dense").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "any", "total"))).first()
    model.low_discounts = discounts([m.n1, m.n2, m.n3, m.n4])
    model.spread = (m.n1, m.n2, m["any"] - m.n1 - m.n2)
    return model


def _discount(c: np.ndarray, d: tuple) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0)


def log10_probabilities(model: Model, h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token its training count and log10 probabilities by the base and by the model."""
    ids, before, back, (part, place) = _pair_keys(model, h, begin)
    path, v = model.path, model.v
    count = _gather(path, "word-counts", part, place, np.int64)[back]
    after = _gather(path, "word-after", part, place, np.uint32)[back]
    base = np.log10((count + 0.5) / (model.n + 0.5 * (v + 1)))
    low = (_discount(after, model.low_discounts) + np.dot(model.low_discounts, model.spread) / (v + 1)) / model.pairs if model.pairs else np.full(len(h), 1 / (v + 1))
    follow = _gather(path, "word-follow", part, place, np.uint32, 3)[back] @ np.array(model.discounts)
    seen, mass = np.zeros(len(h), np.int64), np.zeros(len(h))
    seen[1:], mass[1:] = count[:-1], follow[:-1]
    seen[begin[:-1]], mass[begin[:-1]] = model.docs, np.dot(model.discounts, model.start)
    both = np.flatnonzero((ids >= 0) & (before >= 0))
    u, at = np.unique((before[both].astype(U) << U(32)) | ids[both].astype(U), return_inverse=True)
    pair = np.zeros(len(h), np.int64)
    pair[both] = _pair_counts(model, *_find(path, "pair", model.pair_first, model.pair_size, u))[at]
    p = np.where(seen > 0, (_discount(pair, model.discounts) + mass * low) / np.maximum(seen, 1), low)
    return count, base, np.log10(p)


FORM = T.StructType().add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")


def _scorer(model: Model):
    def run(texts: pd.Series) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        for *_, h, begin in tokens(iter([pa.record_batch([pa.array(texts, pa.binary())], names=["text"])])):
            count, base, ours = log10_probabilities(model, h, begin)
            out.append((np.diff(begin), *(np.add.reduceat(x, begin[:-1]) for x in ((count > 0).astype(np.int64), base, ours))))
        return pd.DataFrame(dict(zip(FORM.names, map(np.concatenate, zip(*out)))))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_tokens, n_known, base_score and score; perplexity is 10 ** (-score / n_tokens)."""
    prepare(docs.sparkSession)
    own = docs.drop(*FORM.names)
    done = fresh("done", own)
    scorer = F.pandas_udf(_scorer(model), FORM)
    return own.withColumn(done, scorer(F.coalesce("text", F.lit("")).cast("binary"))).select(*own.columns, f"{done}.*")
