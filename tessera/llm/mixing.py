"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents fall into cells, one for each combination of the dimensions (source, language, topic, ...). Raking scales the cells' token
weights to each dimension's target shares in turn until all marginals agree. A document of a cell is drawn with probability
min(1, L * weight / tokens), where L is set so that the expected tokens are `keep` of all; draws depend on a hash of the row and the seed
only, so a repeated run takes the same rows.

Up to `local_cells` cells are raked on the driver; more, by the same steps on a table of cells. Both give the same weights.

Defined results: a null value of a dimension is a value of its own. Shares of one dimension are scaled to one over the values that have
tokens; values without a target have share zero, so their documents are never drawn; a dimension without any targets is left as it is. Where
targets contradict each other (cells that don't exist) raking ends after `rounds`. Cells without tokens have probability zero. Where L would have to exceed all
bounds (keep is more than the cells with weight hold) all their documents are drawn. Repeated rows are drawn together. Other columns go through
unchanged; `n_tokens` and `probability` are replaced.

Cells are matched by the values of all dimensions, nulls included, so no two of them can be mistaken for each other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, stored

LOCAL_CELLS = 200_000


def n_tokens(text: Column) -> Column:
    """Words of text."""
    words = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    return F.when(words[0] == "", F.lit(0)).otherwise(F.size(words)).cast("long")


@dataclass
class Mix:
    """cells: each dimension (d0, d1, ...), tokens, weight (sums to one), p."""

    cells: DataFrame
    dims: list[str]
    small: bool


def _same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(Column.__and__, (left[a].cast("string").eqNullSafe(right[b]) for a, b in pairs))


def cells_of(docs: DataFrame, dims: list[str], tokens: str) -> DataFrame:
    own = docs.select(*(F.col(d).cast("string").alias(f"d{i}") for i, d in enumerate(dims)), F.col(tokens).alias("tokens"))
    return own.groupBy(*(f"d{i}" for i in range(len(dims)))).agg(F.sum("tokens").cast("double").alias("tokens")).filter("tokens > 0")


def tempered(cells: DataFrame, dims: list[str], alpha: float) -> dict[str, DataFrame]:
    """Targets in proportion to the present shares to the power alpha: under 1 lifts what is rare."""
    return {d: cells.groupBy(F.col(f"d{i}").alias("value")).agg((F.sum("tokens") ** alpha).alias("share")) for i, d in enumerate(dims)}


def rake(codes: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray | None], rounds: int, tolerance: float) -> np.ndarray:
    """Weights of cells, summing to one. codes: each dimension's value numbers; targets: shares by value number, None for as it is."""
    w = tokens / tokens.sum() if len(tokens) else tokens
    goals = []
    for code, share in zip(codes, targets):
        if share is not None and len(w):
            share = np.where(np.bincount(code, w, len(share)) > 0, share, 0)
            goals.append((code, share / share.sum() if share.sum() else share))
    for _ in range(rounds):
        off = 0.0
        for code, share in goals:
            now = np.bincount(code, w, len(share))
            off = max(off, np.abs(now - share).max(initial=0))
            w = w * np.divide(share, now, out=np.zeros_like(share), where=now > 0)[code]
        if off < tolerance:
            break
    return w / w.sum() if w.sum() else w


def level(weight: np.ndarray, tokens: np.ndarray, keep: float) -> float:
    """The L for which min(1, L * weight / tokens) draws keep of all tokens; infinite if there are not as many with weight."""
    some = weight > 0
    w, t, want = weight[some], tokens[some], keep * tokens.sum()
    if not len(w) or want >= t.sum():
        return float("inf")
    order = np.argsort(-(w / t))  # in this order cells reach probability one
    w, t = w[order], t[order]
    full, rest = np.concatenate([[0], np.cumsum(t)]), np.append(np.cumsum(w[::-1])[::-1], 0)
    for i in range(len(w)):  # the first i cells are full
        found = (want - full[i]) / rest[i]
        if found * w[i] <= t[i]:
            return float(found)
    return float("inf")


def _target(cells: DataFrame, d: str, target: DataFrame) -> DataFrame:
    """v, share: the positive shares of values that cells have."""
    known = cells.select(F.col(d).alias("v")).distinct()
    share = target.filter("share > 0").groupBy(F.col("value").cast("string").alias("value")).agg(F.sum("share").alias("share"))
    return known.join(share, known["v"].eqNullSafe(share["value"])).select("v", "share")


def _local(cells: DataFrame, dims: list[str], targets: dict[str, DataFrame], keep: float, rounds: int, tolerance: float) -> DataFrame:
    rows = cells.toPandas()
    codes, goals = [], []
    for i, d in enumerate(dims):
        code, values = pd.factorize(rows[f"d{i}"], use_na_sentinel=False)
        goal = None
        if d in targets:
            at = {None if pd.isna(v) else v: n for n, v in enumerate(values)}
            goal = np.zeros(len(values))
            for v, s in _target(cells, f"d{i}", targets[d]).collect():  # as many as there are values in the cells, at most
                goal[at[v]] += s
        codes.append(code)
        goals.append(goal)
    tokens = rows["tokens"].to_numpy(float)
    weight = rake(codes, tokens, goals, rounds, tolerance)
    with np.errstate(invalid="ignore"):
        p = np.where(weight > 0, np.minimum(1, level(weight, tokens, keep) * weight / tokens), 0.0) if len(tokens) else tokens
    keyed = rows.assign(weight=weight, p=p)
    return cells.sparkSession.createDataFrame(keyed[[*cells.columns, "weight", "p"]].to_dict("split")["data"], cells.schema.add("weight", "double").add("p", "double"))


def _spread(cells: DataFrame, dims: list[str], targets: dict[str, DataFrame], keep: float, rounds: int, tolerance: float) -> DataFrame:
    total = cells.agg(F.sum("tokens")).first()[0]
    now = stored(cells.withColumn("weight", F.col("tokens") / total), "cells")
    goals = {}
    for i, d in enumerate(dims):
        if d in targets:
            found = _target(cells, f"d{i}", targets[d]).withColumnRenamed("v", "of")
            known = cells.select(F.col(f"d{i}").alias("v")).distinct()
            share = known.join(found, known["v"].eqNullSafe(found["of"]), "left").select("v", F.coalesce("share", F.lit(0.0)).alias("share"))
            whole = share.agg(F.sum("share")).first()[0]
            goals[f"d{i}"] = stored(share.select("v", (F.col("share") / F.lit(whole or 1.0)).alias("share")), "goal")
    for _ in range(rounds):
        off = 0.0
        for d, goal in goals.items():
            sums = now.groupBy(d).agg(F.sum("weight").alias("now"))
            sums = stored(sums.join(goal, sums[d].eqNullSafe(goal["v"])).select("v", "now", "share"), "sums")
            off = max(off, sums.agg(F.max(F.abs(F.col("now") - F.col("share")))).first()[0])
            scale = sums.select("v", F.when(F.col("now") > 0, F.col("share") / F.col("now")).otherwise(0.0).alias("scale"))
            old, now = now, stored(now.join(scale, now[d].eqNullSafe(scale["v"])).withColumn("weight", F.col("weight") * F.col("scale")).drop("scale", "v"), "cells")
            discard(old, sums)
        if off < tolerance:
            break
    whole = now.agg(F.sum("weight")).first()[0] or 1.0
    now = stored(now.withColumn("weight", F.col("weight") / whole), "cells")
    held = now.agg(F.sum(F.when(F.col("weight") > 0, F.col("tokens")))).first()[0] or 0.0
    want, low, high = keep * total, 0.0, total

    def drawn(at: float) -> float:
        return now.agg(F.sum(F.least(F.col("tokens"), at * F.col("weight")))).first()[0]

    if want >= held:
        return now.withColumn("p", F.when(F.col("weight") > 0, 1.0).otherwise(0.0))
    while drawn(high) < want:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if drawn(middle) < want else (low, middle)
        if high - low <= 1e-12 * high:
            break
    return now.withColumn("p", F.least(F.lit(1.0), high * F.col("weight") / F.col("tokens")))


def fit(docs: DataFrame, dims: list[str], tokens: str = "n_tokens", targets: dict[str, DataFrame] | None = None, alpha: float = 0.7, keep: float = 0.5, rounds: int = 200, tolerance: float = 1e-9, local_cells: int = LOCAL_CELLS) -> Mix:
    """targets: for a dimension a table (value, share); without any, the tempered present shares."""
    cells = stored(cells_of(docs, dims, tokens), "cells")
    targets = tempered(cells, dims, alpha) if targets is None else targets
    small = cells.count() <= local_cells
    fitted = (_local if small else _spread)(cells, dims, targets, keep, rounds, tolerance)
    return Mix(fitted, dims, small)


def with_probability(docs: DataFrame, mix: Mix) -> DataFrame:
    """docs with probability."""
    own = docs.drop("probability")
    p, *of = (fresh(x, own) for x in ("p", *(f"d{i}" for i in range(len(mix.dims)))))
    found = mix.cells.select(F.col("p").alias(p), *(F.col(f"d{i}").alias(x) for i, x in enumerate(of)))
    joined = own.join(F.broadcast(found) if mix.small else found, _same(own, found, list(zip(mix.dims, of))), "left")
    return joined.select(*own.columns, F.coalesce(p, F.lit(0.0)).alias("probability"))


def drawn(columns: list[str], probability: str, seed: int) -> Column:
    """Whether a row is drawn: its hash as a number in [0, 1) is under its probability."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / float(1 << 53)
    return u < F.col(probability)


def sample(docs: DataFrame, dims: list[str], seed: int = 17, counted: bool = False, **how) -> DataFrame:
    """The rows of docs (doc_id, text, dims) that are drawn, with n_tokens and probability. counted: docs is a table that has n_tokens."""
    own = docs if counted else stored(docs.withColumn("n_tokens", n_tokens(F.col("text"))), "counted")
    return with_probability(own, fit(own, dims, **how)).filter(drawn(["doc_id", "text"], "probability", seed))
