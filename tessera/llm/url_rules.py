"""URL rules by a sort-merge range join.

A rule (host, path) has the canonical key `reversed host labels NUL path`; the rule covers the interval of keys that begin with it.
Each distinct (host, path) of the pages probes with one key for each suffix of its host, so that subdomains reach the rule as
well. Probes are dealt out by ranges of (key, salt) whose bounds come from a sample, which serves balance only; each rule goes to every
range that its interval meets. In each range, rules and probes are merged in sort order with a stack of the nested rules that are
active: a probe's rule is the top of the stack. Of the rules of a page's suffixes the longest (characters of host and path) wins; on
ties the longer host, then block before allow. The stack is as deep as rules are nested, whatever the number of rows.

Defined results: a null url or one without `://` has an empty host and path. A host that is empty is reached by no rule; empty labels
count as labels. Where no rule fits the verdict is `default`. Rules that are null in any field are ignored; other actions than allow and block
are an error in the rows they decide. Repeated rows come out as often as they went in; other columns go through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, partitions, prepare, stored

NUL = "\x00"
#: Behind every salted key with the same beginning.
LAST = b"\xff" * 9
#: Bounds of ranges are beginnings of keys, of as many bytes at most.
BOUND = 512


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit(NUL), path).cast("binary")


def _sweep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: list[tuple[bytes, str, str]] = []
    span = None
    for batch in it:
        host, path, rule, action = [], [], [], []
        for s, key, is_probe, h, p, r, a in zip(*(batch.column(k).to_pylist() for k in ("span", "key", "is_probe", "host", "path", "rule", "action"))):
            if s != span:
                span, stack = s, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_probe:
                stack.append((key, r, a))
            elif stack:
                host.append(h)
                path.append(p)
                rule.append(stack[-1][1])
                action.append(stack[-1][2])
        if host:
            yield pa.record_batch([pa.array(host), pa.array(path), pa.array(rule), pa.array(action)], names=["host", "path", "rule", "action"])


def _objects(keys: list[bytes]) -> np.ndarray:
    out = np.empty(len(keys), object)
    out[:] = keys
    return out


def match(pairs: DataFrame, rules: DataFrame, sample: int = 20_000) -> DataFrame:
    """host, path, rule, action for the distinct pairs (host, path) that some rule (host, path, action) fits."""
    spark = pairs.sparkSession
    prepare(spark, 4096)
    labels = F.reverse(F.split("host", r"\."))
    probes = pairs.filter("host <> ''").select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: _key(F.slice(labels, 1, n), F.col("path")))).alias("key"))
    probes = stored(probes.withColumn("order", F.concat("key", F.unhex(F.lpad(F.hex(F.xxhash64("host", "path")), 16, "0")))), "probes")
    total = probes.count()
    n = partitions(spark)
    some = probes.filter(F.pmod(F.xxhash64("order"), F.lit(max(1, total))) < sample).select(F.substring("order", 1, BOUND).alias("order"))
    found = sorted(bytes(r[0]) for r in some.limit(2 * sample).collect())
    bounds = _objects(sorted({found[i * len(found) // n] for i in range(1, n)}) if found else [])

    def place(keys: list[bytes]) -> np.ndarray:
        return np.searchsorted(bounds, _objects(keys), "right").astype(np.int32)

    @F.pandas_udf("array<int>")
    def spans(lo: pd.Series) -> pd.Series:
        return pd.Series([np.arange(a, b + 1, dtype=np.int32) for a, b in zip(place(lo.tolist()), place([x + LAST for x in lo]))], dtype=object)

    @F.pandas_udf("int")
    def span(order: pd.Series) -> pd.Series:
        return pd.Series(place(order.tolist()))

    own = rules.filter("host IS NOT NULL AND path IS NOT NULL AND action IS NOT NULL").select(ascii_lower(F.col("host")).alias("host"), "path", "action").distinct()
    own = own.select(_key(F.reverse(F.split("host", r"\.")), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "action")
    own = own.groupBy("key").agg(F.max(F.struct((F.col("action") == "block").alias("first"), "action", "rule")).alias("best"))
    rule_rows = own.select(F.explode(spans("key")).alias("span"), "key", F.lit(False).alias("is_probe"), F.lit("").alias("host"), F.lit("").alias("path"), "best.rule", "best.action")
    probe_rows = probes.select(span("order").alias("span"), "key", F.lit(True).alias("is_probe"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    merged = rule_rows.unionByName(probe_rows).repartition(n, "span").sortWithinPartitions("span", "key", "is_probe")
    hits = merged.mapInArrow(_sweep, "host string, path string, rule string, action string")
    reach = F.instr("rule", "/")  # hosts have no slash
    best = F.max(F.struct(F.length("rule").alias("n"), F.when(reach > 0, reach).otherwise(F.length("rule")).alias("h"), (F.col("action") == "block").alias("b"), "rule", "action")).alias("best")
    return hits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.action")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict in place of columns so named."""
    own = pages.drop("host", "path", "rule", "verdict")
    host, path = "host", "path"
    h, p, r, a = (fresh(x, own) for x in ("h", "p", "r", "action"))
    split = own.withColumn(host, host_of(F.col("url"))).withColumn(path, path_of(F.col("url")))
    found = match(split.select(host, path).distinct(), rules).select(F.col("host").alias(h), F.col("path").alias(p), F.col("rule").alias(r), F.col("action").alias(a))
    both = split.join(found, (split[host] == found[h]) & (split[path] == found[p]), "left")
    known = F.col(a).isNull() | F.col(a).isin("allow", "block")
    verdict = F.when(known, F.coalesce(a, F.lit(default))).otherwise(F.raise_error(F.concat(F.lit("unknown action "), F.col(a))))
    return both.select(*own.columns, host, path, F.col(r).alias("rule"), verdict.alias("verdict"))
