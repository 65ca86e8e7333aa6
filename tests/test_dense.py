"""Dot products of a query set with all vectors, in one block and in several, broadcast and not."""

import pytest

from inkwell.operators import similarity as S


@pytest.mark.parametrize("block, most", [(1024, 8192), (2, 0)])
def test_dense_scores(spark, monkeypatch, block, most):
    monkeypatch.setattr(S, "QUERY_BLOCK", block)
    monkeypatch.setattr(S, "BROADCAST_QUERIES", most)
    data = [(i, [float(i), 1.0, -0.5 * i]) for i in range(12)] + [(3, [3.0, 1.0, -1.5]), (12, None)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id < 5 AND embedding IS NOT NULL")
    got = sorted(((r.query_id, r.vec_id, r.similarity) for r in S.dense_scores(queries, vectors).collect()), key=repr)
    dot = lambda a, b: None if b is None else round(sum(x * y for x, y in zip(a, b)), 6)
    want = sorted(((q, v, dot(a, b)) for q, a in data if q < 5 for v, b in data if v != q), key=repr)
    assert got == want
    assert S.dense_scores(queries.limit(0), vectors).count() == 0
