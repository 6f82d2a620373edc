import random
import re

import pytest

from tessera.llm import substring_dedup as S


def brute(rows, length):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), words in zip(rows, split):
        if doc is not None:
            for i in range(len(words) - length + 1):
                w = tuple(words[i : i + length])
                first[w] = min(first.get(w, doc), doc)
    out = []
    for (doc, _), words in zip(rows, split):
        gone = set()
        for i in range(len(words) - length + 1):
            if doc is not None and first.get(tuple(words[i : i + length]), doc) < doc:
                gone.update(range(i, i + length))
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "gram"), [(6, 3), (5, 5), (1, 1)])
def test_against_brute_force(spark, length, gram):
    rng = random.Random(length)
    passages = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 15))) for _ in range(6)]
    rows = []
    for doc in range(80):
        parts = [rng.choice([*passages, " ".join(rng.choice("klmnop") + str(rng.randint(0, 9)) for _ in range(5))]) for _ in range(rng.randint(0, 4))]
        rows.append((doc, rng.choice([" ", "\n", "\t ", "  "]).join(parts)))
    rows += [(None, rows[3][1]), (200, None), (201, ""), rows[5], rows[5], (5, passages[0] + " É " + passages[0]), (202, "a " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS key", "2 AS parts")
    out = S.substring_dedup(df, length, gram)
    assert out.columns == ["doc_id", "text", "key", "parts", "kept", "n_words", "n_removed"]
    got = sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)
    assert got == brute(rows, length)


def test_maximal(spark):
    rows = [(1, "a b c d e f g"), (2, "x a b c d e f y a b c")]
    got = S.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 3, 2).collect()
    assert [(r.doc_id, [tuple(s) for s in r.spans]) for r in got] == [(2, [(1, 7), (8, 11)])]


def test_empty(spark):
    assert S.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_frequent_anchor_and_very_long_text(spark):
    """One passage with other words before and after in each of many documents, and a long document that repeats itself."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) + f" {passage} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for i in range(400)]
    rows += [(900, "la " * 300_000), (901, "la " * 1000 + passage)]
    got = sorted((tuple(r) for r in S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 20, 8).select("doc_id", "n_words", "n_removed").collect()))
    assert got == [(0, 70, 0), *((i, 70, 30) for i in range(1, 400)), (900, 300_000, 0), (901, 1030, 1030)]
