"""What the catalogue's comparisons with SQL don't reach: model slots, hints, refusals, files."""

from difflib import get_close_matches

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluate, lookup, models, retrieval, structure, tables
from lodestone.sources import files


def test_suggestions_in_blocks(spark, monkeypatch):
    """Over several blocks of valid ids the same as difflib over all of them."""
    ids = [f"{a}.{b}" for a in range(90, 130) for b in range(1, 6)]
    asked = ["250.5", "90.11", "zzz", "121", "", "1.9"]
    want = {x: get_close_matches(x, sorted(ids), n=5, cutoff=0.4) for x in asked}
    df, valid = spark.createDataFrame([(x,) for x in asked], "id string"), spark.createDataFrame([(x,) for x in ids], "id string")
    for most in (100_000, 37):
        monkeypatch.setattr(lookup, "MAX_VALID", most)
        assert {r.id: r.similar for r in lookup.suggestions(df, valid).collect()} == want


def test_hints(spark):
    asked = spark.createDataFrame([(1, 0, "section", "250.5"), (1, 1, "table", " 220.5 ")], "req_id int, ord int, kind string, raw_id string")
    sections = spark.createDataFrame([("250.50", 250, 3, "x"), ("250.52", 250, 3, "x")], "section string, article long, page int, text string")
    made = spark.createDataFrame([("Table220.55", "m")], "table_id string, markdown string")
    got = lookup.hinted_lookup(asked, sections, made).first().answer
    assert got == "Error: section '250.5' not found. Similar section IDs: 250.52, 250.50\n\nError: table '220.5' (normalised: 'Table220.5') not found. Similar table IDs: Table220.55"


def test_embedding_slot(spark):
    """Texts reach the model in order, some at a time, with the prompt in front; null is an empty text."""

    def load():
        return lambda texts: [[float(len(x)), float(len(texts)), float(x.startswith("query: "))] for x in texts]

    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(10)], "id int, t string").coalesce(1)
    rows = df.withColumn("v", models.embedding("t", load, batch=4, prompt="query: ")).orderBy("id").collect()
    assert [r.v for r in rows] == [[7.0 + i, 4.0 if i < 8 else 2.0, 1.0] for i in range(10)]
    s = df.withColumn("s", models.pair_score("t", F.lit("xxx"), models.longer)).orderBy("id").collect()
    assert np.allclose([r.s for r in s], [1 / (1 + np.exp(-(3 - i) / 100)) for i in range(10)])


def test_unique_ids(spark):
    one = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a")], "stream long, chunk_id string")
    assert structure.with_unique_ids(one).count() == 3
    with pytest.raises(ValueError, match="streams 1"):
        structure.with_unique_ids(one.union(spark.createDataFrame([(1, "a")], one.schema)))


def test_cache_takes_even_rows_only(spark):
    s = "table_id string, structure " + tables.STRUCTURE
    cache = spark.createDataFrame([("A", ("a", ["x"], [["1"]], [])), ("B", ("b", ["x"], [["1"]], []))], s)
    fresh = spark.createDataFrame([("A", ("new", ["x"], [["2"]], [])), ("B", ("ragged", ["x", "y"], [["2"]], [])), ("C", None)], s)
    assert {r.table_id: r.structure.title for r in tables.updated(cache, fresh).collect()} == {"A": "new", "B": "b"}


def test_strict_prefix(spark):
    none = F.array().cast("array<string>")
    rows = spark.createDataFrame([("300.5",), ("300.50",), ("300.5(A)",), ("30.1",)], "s string")
    for strict, want in ((False, ["300.5", "300.5(A)", "300.50"]), (True, ["300.5", "300.5(A)"])):
        got = rows.where(evaluate.chunk_matches(F.col("s"), none, F.array(F.lit("300.5")), none, strict)).collect()
        assert sorted(r.s for r in got) == want


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_topk_in_passes(spark, monkeypatch, most):
    """Queries in one pass or many, ties by id, fewer vectors than k."""
    monkeypatch.setattr(retrieval, "MAX_QUERIES", most)
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (40, 3)).astype(float)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "vec_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(7)], "query_id long, embedding array<float>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for k in (6, 60):
        got = [tuple(r) for r in retrieval.topk(rows, q, k).orderBy("query_id", "rank").select("query_id", "vec_id", "distance").collect()]
        want = []
        for i in range(7):
            d = np.round(1 - unit[i] @ unit.T, 9) + 0.0
            want += [(i, int(j), d[j]) for j in np.lexsort((np.arange(40), d))[:k]]
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_lexical_in_passes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7, 12, 1 + i % 3))) for i in range(50)] + [(50, None), (51, "")], "doc_id long, text string").repartition(4)
    q = spark.createDataFrame([(0, "w1 w2 w3"), (1, "w9 W11"), (2, ""), (3, None), (4, "none of these")], "query_id long, text string")
    whole = sorted(map(tuple, retrieval.lexical(q, docs, 8).collect()))
    monkeypatch.setattr(retrieval, "MAX_TEXTS", 1)
    assert sorted(map(tuple, retrieval.lexical(q, docs, 8).collect())) == whole and {r[0] for r in whole} == {0, 1} and len(whole) == 16


def test_paragraph_files(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 'a "quote"\nline', 3), (0, 10, None, None), (2, 1, "é", 4)], "stream long, idx long, content string, page int")
    files.save_streams(df, str(tmp_path / "x"))
    assert sorted(map(repr, files.streams(spark, str(tmp_path / "x")).collect())) == sorted(map(repr, df.collect()))
