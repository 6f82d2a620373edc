import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as M
from tessera.llm import topics as T
from tessera.llm import words as W


def docs(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y"]), rng.choice(["t", "u", "v"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string").repartition(3)


def brute_rake(rows, targets, rounds=500):
    cells = {}
    for _, text, *key in rows:
        if text:
            cells[tuple(key)] = cells.get(tuple(key), 0) + len(text.split())
    w = dict(cells)
    for _ in range(rounds):
        for i, t in enumerate(targets):
            sums = {}
            for k, x in w.items():
                sums[k[i]] = sums.get(k[i], 0) + x
            w = {k: x * t.get(k[i], 0) / sums[k[i]] if sums[k[i]] else 0 for k, x in w.items()}
    total = sum(w.values())
    return cells, {k: x / total for k, x in w.items()}


@pytest.mark.parametrize("local", [1000, 0])
def test_raking_and_level(spark, local):
    rows, df = docs(spark)
    shares = [{"a": 0.2, "b": 0.5, None: 0.3}, {"x": 0.9, "y": 0.1}, {"t": 0.5, "u": 0.5, "v": 0.0}]
    targets = {d: spark.createDataFrame(list(s.items()), "value string, share double") for d, s in zip(("source", "lang", "topic"), shares)}
    own = df.withColumn("n_tokens", M.n_tokens(F.col("text")))
    mix = M.fit(own, ["source", "lang", "topic"], targets=targets, keep=0.2, local_cells=local)
    cells, want = brute_rake(rows, shares)
    got = {(r.d0, r.d1, r.d2): r for r in mix.cells.collect()}
    assert set(got) == set(cells)
    for k, r in got.items():
        assert (r.tokens, r.weight) == (cells[k], pytest.approx(want[k], abs=1e-7))
        assert r.p == 0 if k[2] == "v" else 0 < r.p <= 1
    assert sum(r.p * r.tokens for r in got.values()) == pytest.approx(0.2 * sum(cells.values()), rel=1e-6)
    free = [r for r in got.values() if 0 < r.p < 1]
    assert np.ptp([r.p * r.tokens / r.weight for r in free]) < 1e-3 * max(r.p * r.tokens / r.weight for r in free)


def test_sample(spark):
    rows, df = docs(spark, 4000)
    out = M.sample(df.selectExpr("*", "1 AS key", "2 AS p"), ["source", "lang", "topic"], alpha=0.5, keep=0.4)
    assert out.columns == ["doc_id", "text", "source", "lang", "topic", "key", "p", "n_tokens", "probability"]
    got = out.collect()
    total = sum(len(t.split()) for _, t, *_ in rows)
    assert abs(sum(r.n_tokens for r in got) / total - 0.4) < 0.03
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, M.sample(df.selectExpr("*", "1 AS key", "2 AS p"), ["source", "lang", "topic"], alpha=0.5, keep=0.4).collect()), key=repr)
    assert M.sample(df, ["source"], keep=1.0).count() == len(rows)
    assert M.sample(df.limit(0), ["source", "lang"]).count() == 0


def test_tokens(spark):
    texts = [None, "", " \n", "a", " a\tb\x0bc \n", "é\xa0f g"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(M.n_tokens(F.col("text"))).collect()] == [0, 0, 0, 1, 3, 2]


@pytest.mark.parametrize("local", [1000, 0])
def test_values_that_look_alike(spark, local):
    """Separators within values, NUL and null make different cells; each row comes out once."""
    rows = [(1, "w w", "a\x1fb", "c"), (2, "w", "a", "b\x1fc"), (3, "w w w", "\x00", "c"), (4, "w", None, "c"), (5, "w", "", "c"), (6, "w", "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d0 string, lang string")
    own = df.withColumn("n_tokens", M.n_tokens(F.col("text")))
    mix = M.fit(own, ["d0", "lang"], keep=1.0, local_cells=local)
    assert mix.cells.count() == 6
    out = M.with_probability(own, mix)
    assert out.columns == [*own.columns, "probability"]
    assert sorted((r.doc_id, r.probability) for r in out.collect()) == [(i, 1.0) for i in range(1, 7)]


def test_targets_of_other_values(spark):
    _, df = docs(spark, 50)
    many = spark.createDataFrame([(f"other{i}", 1.0) for i in range(500)] + [("x", 1.0)], "value string, share double")
    mix = M.fit(df.withColumn("n_tokens", M.n_tokens(F.col("text"))), ["lang"], targets={"lang": many}, keep=0.1)
    assert {r.d0: r.weight for r in mix.cells.collect()} == {"x": 1.0, "y": 0.0}


def test_topics_are_learnt(spark):
    rng = random.Random(3)
    subjects = [[f"{s}{i}" for i in range(30)] for s in ("sea", "star", "bread")]
    rows = [(i, " ".join(rng.choice(subjects[i % 3]) if rng.random() < 0.6 else f"the{rng.randrange(8)}" for _ in range(rng.randint(20, 60)))) for i in range(240)]
    rows += [(900, None), (901, " \n"), (None, rows[0][1]), rows[1], (902, ("Sea1 SEA2 sea3 " * 100_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS done", "2 AS topic").repartition(3)
    model = T.fit(df, topics=3)
    out = T.read(df, model)
    assert out.columns == ["doc_id", "text", "done", "topic", "n_tokens"]
    got = out.collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and len({by_id[i].topic for i in range(3)}) == 3
    assert all(by_id[i].topic == by_id[i % 3].topic for i in range(240))
    assert by_id[900].topic == by_id[901].topic == "none" and by_id[902].topic == by_id[0].topic == by_id[None].topic
    assert all(r.n_tokens == len((r.text or "").split()) for r in got)
    small = T.fit(df, topics=3, sample=100)
    assert len(small.centroids) == 3 and np.array_equal(small.centroids, T.fit(df.repartition(5), topics=3, sample=100).centroids)
    none = T.fit(df.limit(0))
    assert T.read(df.limit(0), none).count() == 0 and {r.topic for r in T.read(df, none).collect()} == {"none"}


def test_topics_are_fitted_on_all_rows(spark):
    """idf counts every row, and the centroids are the means of all rows nearest to them, however many there are and however they are dealt out."""
    rng = random.Random(4)
    subjects = [[f"{s}{i}" for i in range(40)] for s in ("sea", "star", "bread")]
    rows = [(i, " ".join(rng.choice(subjects[i % 3]) for _ in range(30))) for i in range(4500)] + [(9000, "Zebra"), (9001, None), (9002, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.fit(df, topics=3)
    with_words = [text.encode() for _, text in rows if (text or "").split()]
    vectors, seen = np.zeros((len(with_words), T.DIMS)), np.zeros(T.DIMS)
    for i, text in enumerate(with_words):
        words = W.split(np.frombuffer(text, np.uint8), np.array([0, len(text)]), fold=True)
        bucket, tf = np.unique((words.hashes() >> np.uint64(53)).astype(int), return_counts=True)
        seen[bucket] += 1
        vectors[i, bucket] = 1 + np.log(tf)
    idf = np.log((len(with_words) + 1) / (seen + 1)) + 1e-6
    assert np.allclose(model.idf, idf, atol=1e-12)
    vectors *= idf
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    at = (vectors @ model.centroids.T).argmax(axis=1)
    assert len(set(at)) == 3
    for k, c in enumerate(model.centroids):
        mean = vectors[at == k].sum(axis=0)
        assert np.allclose(c / np.linalg.norm(c), mean / np.linalg.norm(mean), atol=1e-4)
    assert np.array_equal(model.centroids, T.fit(df.repartition(7), topics=3).centroids)
