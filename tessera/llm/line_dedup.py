"""Line deduplication over a whole corpus.

Hashes of lines are dealt out by range of (hash, document) and sorted by hash, document and position, so that each task
streams whole runs of equal lines and never holds more of a run than the copies it has to decide on. A run that may go on in
the neighbouring task is decided afterwards from one summary per task and edge. What returns is a compressed bitmap of kept
lines per document, never text.

Two rules: `common` drops every line that is found in at least `min_docs` documents, everywhere; `first` keeps the first
occurrence by (doc_id, position) and drops all later ones.

Defined results: a null or empty text has one empty line. Lines whose key has fewer than `min_chars` code points stay. Rows of
one doc_id count as one document; a null doc_id is one document, before all others. Rows that are equal in doc_id and text share
one bitmap, and as occurrences of a line they count once. Other columns go through unchanged; only `kept`, `n_lines` and
`n_dropped` are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, ascii_lower, discard, fresh, key_hash, partitions, prepare, stored

FORM = "kind int, h1 long, h2 long, doc_id long, f1 long, f2 long, pos int, docs long"
DROP, EDGE, OPEN = 0, 1, 2


def lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2 (of the line's key), doc_id, f1, f2 (of the text), pos: a row for each line that can be dropped."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(n) for c, n in zip(key_hash(text), ("f1", "f2"))), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(ASCII_SPACE)))
    keyed = every.select("doc_id", "f1", "f2", "pos", key.alias("key")).filter(F.length("key") >= max(1, min_chars))
    return keyed.select(*(c.alias(n) for c, n in zip(key_hash(F.col("key")), ("h1", "h2"))), "doc_id", "f1", "f2", "pos")


def _turns(rows: dict[str, np.ndarray], keys: tuple[str, ...]) -> np.ndarray:
    turn = np.ones(len(rows["pos"]), bool)
    turn[1:] = np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in keys])
    return turn


class _Stream:
    """Decides the lines of one task, batch by batch. A run is a stretch of equal (h1, h2).

    Runs at the task's two edges may go on elsewhere: their undecided rows are put out as OPEN, with one EDGE row that has the
    run's first row and its number of documents here (min_docs, once that many are known).
    """

    KEY, DOC, SAME = ("h1", "h2"), ("h1", "h2", "no_id", "doc_id"), ("no_id", "doc_id", "pos", "f1", "f2")

    def __init__(self, rule: str, min_docs: int):
        self.rule, self.min_docs = rule, min_docs
        self.held = None  # the current run's undecided rows; of a decided run its last row
        self.head, self.decided, self.first = None, False, True

    def out(self, kind: int, rows: dict[str, np.ndarray], docs: int = 0) -> pa.RecordBatch:
        n = len(rows["pos"])
        cols = {"kind": pa.array(np.full(n, kind, np.int32))} | {k: pa.array(rows[k]) for k in ("h1", "h2", "doc_id", "f1", "f2", "pos")} | {"docs": pa.array(np.full(n, docs, np.int64))}
        cols["doc_id"] = pa.array(rows["doc_id"], mask=rows["no_id"])
        return pa.record_batch(list(cols.values()), names=list(cols))

    def go_on(self, rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """More of the current run; the first of these rows is the marker of a decided run."""
        again = np.logical_and.reduce([rows[k] == self.head[k] for k in self.SAME]) if self.rule == "first" else np.zeros(len(rows["pos"]), bool)
        rest = {k: v[1:][~again[1:]] for k, v in rows.items()}
        if self.decided:
            yield self.out(DROP, rest)
        elif self.rule == "first":
            if self.first:
                yield self.out(OPEN, self.head)
            yield self.out(DROP, rest)
            self.decided = True
        elif _turns(rows, self.DOC).sum() >= self.min_docs:
            yield self.out(DROP, rows)
            self.decided = True
        self.held = {k: v[-1:] for k, v in rows.items()} if self.decided else rows

    def close(self, edge: bool) -> Iterator[pa.RecordBatch]:
        if edge:
            if not self.decided:
                yield self.out(OPEN, self.held)
            yield self.out(EDGE, self.head, self.min_docs if self.decided else int(_turns(self.held, self.DOC).sum()))

    def begin(self, rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.head, self.decided = {k: v[:1] for k, v in rows.items()}, False
        yield from self.go_on(rows)

    def batches(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            rows = {k: batch.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in ("h1", "h2", "doc_id", "f1", "f2", "pos")}
            rows["no_id"] = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            begins = self.held is None
            if not begins:
                rows = {k: np.concatenate([self.held[k], v]) for k, v in rows.items()}
            n = len(rows["pos"])
            at = np.append(np.flatnonzero(_turns(rows, self.KEY)), n)
            part = lambda a, b: {k: v[a:b] for k, v in rows.items()}  # noqa: B023, E731
            yield from (self.begin if begins else self.go_on)(part(0, at[1]))
            if len(at) > 2:
                yield from self.close(self.first)
                self.first = False
                yield from self.whole(part(at[1], at[-2]))
                yield from self.begin(part(at[-2], n))
        if self.held is not None:
            yield from self.close(True)

    def whole(self, rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Runs that begin and end here."""
        drop = ~_turns(rows, self.KEY)
        at, size = np.flatnonzero(~drop), len(drop)
        if self.rule == "first":
            head = np.repeat(at, np.diff(np.append(at, size)))
            drop &= ~np.logical_and.reduce([rows[k] == rows[k][head] for k in self.SAME])
        elif size:
            drop = np.repeat(np.add.reduceat(_turns(rows, self.DOC).astype(np.int64), at) >= self.min_docs, np.diff(np.append(at, size)))
        if drop.any():
            yield self.out(DROP, {k: v[drop] for k, v in rows.items()})


def dropped_lines(docs: DataFrame, rule: str = "common", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, f1, f2, pos of each dropped line."""
    if rule not in ("common", "first"):
        raise ValueError(f"unknown rule {rule!r}")
    spark = docs.sparkSession
    prepare(spark)
    # stored: bounds of ranges come from a sample, which would split all texts once more
    hashed = stored(lines(docs, min_chars), "hashed")
    spread = hashed.repartitionByRange(partitions(spark), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos", "f1", "f2")
    found = stored(spread.mapInArrow(lambda it: _Stream(rule, min_docs).batches(it), FORM), "lines")
    discard(hashed)
    open_rows, edges = found.filter(F.col("kind") == OPEN), found.filter(F.col("kind") == EDGE)
    # a summary or two for each task, and fewer than min_docs documents' rows
    if rule == "common":
        late = open_rows.join(edges.groupBy("h1", "h2").agg(F.sum("docs").alias("n")).filter(F.col("n") >= min_docs), ["h1", "h2"], "left_semi")
    else:
        sooner = edges.select("h1", "h2", F.struct(F.col("doc_id").isNotNull(), "doc_id").alias("before")).groupBy("h1", "h2").agg(F.min("before").alias("before"))
        late = open_rows.join(sooner, ["h1", "h2"]).filter(F.col("before") < F.struct(F.col("doc_id").isNotNull(), "doc_id"))
    cols = ["doc_id", "f1", "f2", "pos"]
    return found.filter(F.col("kind") == DROP).select(cols).unionByName(late.select(cols))


@F.pandas_udf(T.BinaryType())
def _packed(positions: pd.Series, n: pd.Series) -> pd.Series:
    def one(p: np.ndarray, lines: int) -> bytes:
        keep = np.ones(-(-lines // 8) * 8, bool)
        keep[p] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(p, m) for p, m in zip(positions, n)], dtype=object)


def keep_bitmaps(docs: DataFrame, rule: str = "common", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, f1, f2 (hashes of the text), bitmap: one row for each text that loses lines. bitmap: zlib over packed bits, as many
    as its last dropped line needs; lines beyond stay."""
    dropped = dropped_lines(docs, rule, min_docs, min_chars).groupBy("doc_id", "f1", "f2").agg(F.collect_set("pos").alias("at"), F.max("pos").alias("last"))
    return dropped.select("doc_id", "f1", "f2", _packed("at", F.col("last") + 1).alias("bitmap"))


@F.pandas_udf(T.StructType().add("kept", "string").add("n_lines", "long").add("n_dropped", "long"))
def _applied(text: pd.Series, bitmap: pd.Series) -> pd.DataFrame:
    def one(t: str, bits: bytes) -> tuple[str, int, int]:
        rows = t.split("\n")
        if bits is None:
            return t, len(rows), 0
        keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[: len(rows)].tolist()
        keep += [1] * (len(rows) - len(keep))
        kept = [r for r, k in zip(rows, keep) if k]
        return "\n".join(kept), len(rows), len(rows) - len(kept)

    return pd.DataFrame([one(t, b) for t, b in zip(text, bitmap)], columns=["kept", "n_lines", "n_dropped"])


def line_dedup(docs: DataFrame, rule: str = "common", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with `kept` (the text of the lines that stay), `n_lines` and `n_dropped` in place of columns so named; a document that
    loses all its lines has an empty text. See the module for the rules and the defined results."""
    prepare(docs.sparkSession)
    own = docs.drop("kept", "n_lines", "n_dropped")
    key, of, bits, done = (fresh(x, own) for x in ("key", "of", "bits", "done"))
    text = F.coalesce(F.col("text"), F.lit(""))

    def named(*cols):
        return F.struct(*(c.alias(n) for c, n in zip(cols, "abc")))

    maps = keep_bitmaps(docs, rule, min_docs, min_chars).select(named(F.col("doc_id"), F.col("f1"), F.col("f2")).alias(of), F.col("bitmap").alias(bits))
    keyed = own.withColumn(key, named(F.col("doc_id").cast("long"), *key_hash(text)))
    return keyed.join(maps, keyed[key].eqNullSafe(maps[of]), "left").withColumn(done, _applied(text, bits)).select(*own.columns, f"{done}.*")
