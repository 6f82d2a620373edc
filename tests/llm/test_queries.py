"""The registered queries: columns as contracted, and those with SQL against DuckDB, on small tables."""

import random

import duckdb
import pytest

from tessera.llm import queries as Q

COLUMNS = {
    "op4_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op7_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_kneser_ney": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op10_url_rules": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    d = str(tmp_path_factory.mktemp("tables"))
    words = ["The", "of", "é", "x\x0b"] + [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 6))) for _ in range(80)]
    texts = [x + (f"\n{passage}" if i % 7 == 0 else "") + ("\n  Shared LINE\t" if i % 3 == 0 else "") for i, x in enumerate(texts)] + ["", None]
    spark.createDataFrame([(i, x, "en", f"s{i % 3}", 1) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(60)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    urls = [rng.choice(["http://", "https://"]) + rng.choice(["WWW.a.", "", "b."]) + rng.choice(["example.org", "x.com", "org", "y.net"]) + rng.choice(["/es/1", "/en/12", "/fr/", "/de/9", "", "/"]) + rng.choice(["", "?q", "#t"]) for _ in range(60)]
    spark.createDataFrame([(i, u, "<p>a") for i, u in enumerate([*urls, None, "nothing"])], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, tables, name):
    got = dict(Q.QUERIES[name](spark, tables).dtypes)
    assert {k: got.get(k) for k in COLUMNS[name]} == COLUMNS[name]


@pytest.mark.parametrize("name", Q.ORACLE_SQL)
def test_sql(spark, tables, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    rows = Q.QUERIES[name](spark, tables)
    want = db.sql(Q.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(rows.columns)
    assert sorted(map(repr, map(tuple, rows.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_other_queries(spark, tables):
    found = {r.doc_id for r in Q.QUERIES["op2_decontaminate"](spark, tables).collect() if r.contaminated}
    assert found == set(range(0, 80, 7))
    assert {r.text for r in Q.QUERIES["op3_html_text"](spark, tables).collect()} == {"a"}
    mixed = Q.QUERIES["op1_mixing"](spark, tables).collect()
    assert len(mixed) == 82 and any(r.drawn for r in mixed) and all(0 <= r.probability <= 1 for r in mixed)
