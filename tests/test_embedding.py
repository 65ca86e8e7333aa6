"""The offline embedder against a dense decomposition, copies, and retrieval with real vectors."""

import random

import numpy as np
import pytest

from inkwell.operators import embedding
from inkwell.plans.catalogue import QUERIES
from inkwell.sources.providers import embed

SF = "/root/testdata/sf0.001"


def test_against_a_dense_decomposition(spark):
    rng = random.Random(5)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(6)]
    texts = [" ".join(rng.choice(rng.choice([topics[i % 6]] * 9 + topics)) for _ in range(25)) for i in range(300)] + [None, "", "unknown é"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    model = embedding.fit(frame, values=6, passes=4)
    a = model.rows(texts)
    values = np.linalg.svd(a, compute_uv=False)
    assert model.total == pytest.approx((a * a).sum())
    assert model.explained() >= 0.98 * float((values[:6] ** 2).sum() / (values**2).sum()) and model.values[0] == pytest.approx(values[0], rel=1e-3)
    assert np.allclose(model.vectors.T @ model.vectors, np.eye(6), atol=1e-8)
    got = np.array(model.embed(texts))
    assert np.allclose(np.linalg.norm(got[:300], axis=1), 1) and not got[300:302].any()
    same = got[:300] @ got[:300].T
    own, other = same[np.arange(300)[:, None] % 6 == np.arange(300) % 6].mean(), same[np.arange(300)[:, None] % 6 != np.arange(300) % 6].mean()
    assert own > other + 0.4
    rows = {r.doc_id: r.embedding for r in embed(frame, "text", model).collect()}
    assert all(np.allclose(rows[i], got[i], atol=1e-6) for i in range(len(texts)))
    assert embedding.fit(frame.limit(0)).embed(["a word"]) == [[0.0] * embedding.VALUES]


def test_copies_rank_first(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["semantic_neighbours"](spark, SF).collect()
    assert {r.query_id for r in got} == {i for i in texts if i % 20 == 0}
    for i in {r.query_id for r in got}:
        copies = [j for j, t in texts.items() if j != i and t == texts[i] and embedding.words_of(t)]
        best = max((r.similarity for r in got if r.query_id == i), default=0)
        assert not copies or best == pytest.approx(1, abs=1e-5)


def test_questions_have_their_own_vectors(spark):
    got = QUERIES["grounded_retrieval"](spark, SF).collect()
    assert {r.query_id for r in got} == {1, 2, 3} and all(len({r.grounded for r in got if r.query_id == q}) == 1 for q in (1, 2, 3))
    assert all(r.grounded == (max(x.score for x in got if x.query_id == r.query_id) >= 0.15) for r in got)
