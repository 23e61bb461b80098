"""What a Python worker holds at once doesn't grow with the number of queries."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators import retrieval

N, VECTORS, DIM = 2000, 1500, 4


@pytest.fixture
def captured(monkeypatch):
    """The function that goes to the workers."""
    from pyspark.sql.classic.dataframe import DataFrame

    real, got = DataFrame.mapInArrow, []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **b: (got.append(f), real(self, f, *a, **b))[1])
    return got


def peak_mb(run):
    tracemalloc.start()
    out = list(run())
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, most


def test_vector_search(spark, captured):
    rng = np.random.default_rng(0)
    q, v = rng.integers(-3, 4, (N, DIM)).astype(np.float32), rng.integers(-3, 4, (VECTORS, DIM)).astype(np.float32)
    ids = rng.permutation(VECTORS)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<float>")
    retrieval.topk(frame.withColumnRenamed("query_id", "vec_id"), frame, 5)
    batch = pa.record_batch([pa.array(ids), pa.array(v.tolist(), pa.list_(pa.float32()))], ["vec_id", "embedding"])
    out, most = peak_mb(lambda: captured[0](iter([batch])))
    assert most < 80
    unit = lambda x: x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    far = np.round(1 - unit(q) @ unit(v).T, 9) + 0.0
    got = {}
    for b in out:
        for r in b.to_pylist():
            got.setdefault(r["query_id"], []).append((r["distance"], r["vec_id"]))
    for i in range(N):
        order = np.lexsort((ids, far[i]))[:5]
        assert got[i] == [(far[i][j], ids[j]) for j in order]


def test_lexical_search(spark, captured):
    asked = spark.createDataFrame([(i, f"word{i % 7} other{i}") for i in range(400)], "query_id long, text string")
    retrieval.lexical(asked, asked.withColumnRenamed("query_id", "doc_id"), 5)
    batch = pa.record_batch([pa.array(range(10_000)), pa.array([[f"word{i % 7}", "other3"] for i in range(10_000)])], ["doc_id", "dt"])
    out, most = peak_mb(lambda: captured[0](iter([batch])))
    assert most < 80
    three = [(r["doc_id"], r["both"]) for b in out for r in b.to_pylist() if r["query_id"] == 3]
    assert three == [(3, 2), (10, 2), (17, 2), (24, 2), (31, 2)]
