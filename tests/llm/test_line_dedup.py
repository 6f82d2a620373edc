import random
import re

import pytest

from tessera.llm import line_dedup as L


def brute(rows, rule, min_docs, min_chars=1):
    def key(line):
        return re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    docs = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            docs.setdefault(key(line), set()).add(doc)
    seen, out = {}, []
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc, text in order:
        for i, line in enumerate((text or "").split("\n")):
            seen.setdefault(key(line), (doc, i))
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for i, line in enumerate(lines):
            k = key(line)
            drop = len(k) >= min_chars and (len(docs[k]) >= min_docs if rule == "common" else seen[k] != (doc, i))
            if not drop:
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rule", ["common", "first"])
@pytest.mark.parametrize("batch", [1, 3, 512])
def test_against_brute_force(spark, rule, batch):
    rng = random.Random(5)
    words = ["a", "B", " b ", "", "é", "c\t", "d" * 5, "hot"]
    rows = [(i, "\n".join(rng.choice(words + [f"u{rng.random()}"]) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    rows += [(None, "hot\nx"), (100, None), (101, ""), rows[3], rows[3], (102, "hot\n" * 50)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = L.line_dedup(df, rule, min_docs=5).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(tuple, got), key=repr) == brute(rows, rule, 5)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, kept int, bits string, key string")
    out = L.line_dedup(df)
    assert out.columns == ["doc_id", "text", "bits", "key", "kept", "n_lines", "n_dropped"]
    assert out.count() == 0
