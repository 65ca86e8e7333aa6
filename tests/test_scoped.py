"""TF-IDF fitted on one document: what is made of a text stays in its row."""

import math

import pytest
from pyspark.sql import functions as F

from inkwell.operators import similarity as S

TEXT = "The quick model learns features of data. " * 3 + "Another sentence stands between all of these lines here. " + "The quick model learns features of data."


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, "One two three. Four five six."), (3, ""), (4, None)], "doc_id long, text string")


@pytest.mark.parametrize("of", [S.keyword_scores, S.keywords, S.summary_sentences, S.cohesion, S.repeated_sentences])
def test_terms_are_neither_shuffled_nor_sorted_in_windows(docs, of):
    plan = of(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_pairs_keep_their_texts_in_one_row(spark):
    pairs = spark.createDataFrame([(1, "a model learns", "a model learns"), (2, None, "text")], "pair_id long, a string, b string")
    got = S.pair_similarity(pairs, "pair_id", "a", "b")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.pair_id: r.cosine for r in got.collect()} == {1: 1.0, 2: 0.0}


def test_copies_in_one_document_give_the_first_pairs_only(spark):
    text = " ".join(["Every sentence of this document is a plain copy of one."] * 3000)
    rows = S.repeated_sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("rank").collect()
    assert [(r.i, r.j) for r in rows] == [(0, j) for j in range(2, 27)] and {r.similarity for r in rows} == {1.0}


def test_repeats_meet_brute_force():
    words = [f"w{k}" for k in range(12)]
    units = [{"pos": i, "words": [words[(i * k + k * k) % (5 + i % 7)] for k in range(6)]} for i in range(60)]
    v = S._vectors(units)
    every = sorted((-math.floor(S._dot(v[i], v[j]) * 1e6 + 0.5) / 1e6, i, j) for i in v for j in v if j - i > 1)
    want = [x for x in every if -x[0] >= 0.8]
    assert len(want) > 40
    assert [(-r["similarity"], r["i"], r["j"]) for r in S._repeats(0.8, 40)(units)] == want[:40]


def test_repeated_ids_are_one_scope(spark):
    twice = spark.createDataFrame([(1, "alpha beta. gamma delta."), (1, "alpha gamma. beta beta.")], "doc_id long, text string")
    rows = {r.term: r["rank"] for r in S.keyword_scores(twice).where(~F.col("term").contains(" ")).collect()}
    assert set(rows) == {"alpha", "beta", "gamma", "delta"}
