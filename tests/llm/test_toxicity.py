import random

import numpy as np
import pandas as pd
import pyarrow as pa

from tessera.llm import toxicity as X
from tessera.llm import words as W


def corpus(n=400):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["Scoundrel,", "villain", "wretch!"]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_terms_count():
    data, at = W.binary(pa.array(["Ab ab, abcdE abcd", "", None]))
    doc, term, tf = X.terms(data, at)
    assert doc.tolist() == [0] * len(doc) and sorted(tf.tolist()) == [1, 1, 1, 2, 2]  # ab twice; beginning abcd twice; two words; abcde's five bytes


def test_index_is_exact():
    rng = np.random.default_rng(0)
    kept = np.sort(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    rows = [(d, int(kept[t]), int(rng.integers(1, 5))) for d in range(700) for t in rng.choice(60, rng.integers(0, 8), replace=False)]
    rows = pd.DataFrame(rows, columns=["doc_id", "term", "tf"])
    examples = pd.DataFrame({"doc_id": np.arange(700), "label": rng.integers(0, 2, 700)})
    df = np.full(60, 50.0)
    df[:30] = 5
    index = X.build(rows, examples, kept, df)
    assert index.count.sum() == 700 and index.most.shape[1] > 5
    full = np.zeros((len(index.bias), 61))
    full[:, 60] = index.bias
    for t in range(60):
        a, b = index.start[t * index.most.shape[1]], index.start[(t + 1) * index.most.shape[1]]
        full[index.entry[a:b], t] = index.weight[a:b]
    assert np.allclose((full**2).sum(axis=1), 1)
    for _ in range(100):
        place = np.sort(rng.choice(60, rng.integers(0, 9), replace=False))
        tf = rng.integers(1, 5, len(place))
        w, b = index.vector(place, tf)
        cos = full[:, place] @ w + b * full[:, 60]
        ids, got = index.nearest(place, tf)
        assert np.allclose(got, np.sort(cos)[::-1][: X.NEAREST])
        assert np.allclose(cos[ids], got)


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.random(500)
    knots, rate = X.isotonic(x, (rng.random(500) < x).astype(float), np.ones(500))
    assert (np.diff(knots) >= 0).all() and (np.diff(rate) >= 0).all() and 0 < rate[0] < 0.2 and 0.8 < rate[-1] < 1


def test_held_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "villain villain"), (1000, None), (1001, ""), rows[0][:2], rows[0][:2]], "doc_id long, text string").selectExpr("*", "1 AS done").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(0, None), (None, 1), (3, 7), (1, 0)], "doc_id long, label int")
    out = X.score(docs, X.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "done", "score", "evidence"]
    got = out.collect()
    assert len(got) == len(rows) + 5
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].score >= X.THRESHOLD) == bool(y) for i, _, y in rows if i % 3 == 0)
    assert by_id[None].score >= X.THRESHOLD and by_id[1000].score == by_id[1001].score < 0.1
    best = by_id[0].evidence[0]
    assert best.cosine > 0.5 and best.share > 0.9 and best.doc_id % 3


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert [(r.score, r.evidence) for r in X.score(docs, X.fit(docs, none)).collect()] == [(0.0, [])]
    one = spark.createDataFrame([(1, 1)], "doc_id long, label int")
    assert X.score(docs.limit(0), X.fit(docs, one)).count() == 0
    assert 0 <= X.score(docs, X.fit(docs, one)).first().score <= 1


def test_all_labels_that_have_documents_are_used(spark):
    """The bound is on examples, not on labels: most labels have no document here."""
    rows = corpus(100)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(i, 0) for i in range(1000, 3000)], "doc_id long, label int")
    assert X.fit(docs, labels, max_examples=150).count.sum() == 100
    assert X.fit(docs, labels, max_examples=60).count.sum() == 60


def test_many_toxic_words(spark):
    """600 toxic words, of which a text has one or two: none is cut."""
    rng = random.Random(5)
    common, bad = [f"w{i}" for i in range(100)], [f"{chr(97 + i % 26)}{chr(97 + i // 26)}x{i}" for i in range(600)]
    rows = [(i, " ".join([rng.choice(common) for _ in range(8)] + [bad[i // 2 % 600]] * (i % 2)), i % 2) for i in range(12_000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    index = X.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows if i < 10_800], "doc_id long, label int"), max_examples=10_800)
    got = {r.doc_id: r.score for r in X.score(docs.filter("doc_id >= 10800"), index).collect()}
    assert len(index.terms) > 500 and sum((got[i] >= X.THRESHOLD) == bool(y) for i, _, y in rows if i >= 10_800) > 0.97 * len(got)


def test_very_long_text(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, "w1 w2 w3 " * 200_000), (9001, "w1 w2 w3 " * 200_000 + "villain " * 500_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in X.score(docs, X.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int"))).collect()}
    assert got[9000] < 0.3 and got[9001] >= X.THRESHOLD
