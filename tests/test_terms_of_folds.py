"""Vocabularies of folds against a full count, and fits that read texts once."""

import random
from collections import Counter

from pyspark.ml.feature import CountVectorizerModel

from inkwell.operators import models as M
from inkwell.operators import terms


def full_count(docs, features):
    n, df = Counter(), Counter()
    for ws in docs:
        c = Counter(" ".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
        n.update(c)
        df.update(c.keys())
    return sorted((t for t in n if df[t] > 1), key=lambda t: (-n[t], t.count(" "), t))[:features]


def test_vocabularies_equal_a_full_count(spark):
    """Small features, so that many terms tie at the last place, and more than there are terms."""
    rng = random.Random(5)
    docs = [([rng.choice("abcdefghij"[: rng.choice([3, 10])]) * rng.choice([2, 2, 3]) for _ in range(rng.randrange(30))], i % 3) for i in range(120)]
    docs.append((["once", "and", "for", "all"] * 50, 0))  # frequent in one text only
    rows = terms.numbered(spark.createDataFrame(docs, "_w1 array<string>, fold int").repartition(3), [])
    for features in (5, 40, 5000):
        got = terms.vocabularies(rows, features, 3)
        assert set(got) == {None, 0, 1, 2}
        for left in got:
            assert got[left] == full_count([w for w, k in docs if k != left], features)


def test_empty_texts_have_empty_vocabularies(spark):
    rows = terms.numbered(spark.createDataFrame([([], 0), ([], 1)], "_w1 array<string>, fold int"), [])
    assert terms.vocabularies(rows, 10, 3) == {None: [], 0: [], 1: []}


def test_learners_read_written_counts(spark, monkeypatch):
    """Whatever passes a learner makes, it gets rows of a written table, not a plan that splits texts again."""
    plans = []

    class Learner:
        def fit(self, rows):
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
            return M.classifier("bayes").fit(rows)

    monkeypatch.setattr(M, "classifier", lambda kind, real=M.classifier: Learner() if kind == "watched" else real(kind))
    rows = spark.createDataFrame([(i, "red green blue" if i % 2 else "one two three", str(i % 2)) for i in range(20)], "doc_id long, text string, y string")
    model = M.fit(rows, "y", "watched", features=64)
    assert len(plans) == 1 and "text#" not in plans[0] and "Relation" in plans[0]
    assert {(r.doc_id % 2, r.predicted) for r in M.predict(model, rows).collect()} == {(0, "0"), (1, "1")}


def test_counted_forest_has_its_vocabulary(spark):
    rows = spark.createDataFrame([(i, "red green blue" if i % 2 else "one two three", str(i % 2)) for i in range(20)] + [(99, "null label here", None)] * 2, "doc_id long, text string, y string")
    model = M.counted_forest(rows, "y", features=4, trees=3)
    vocabulary = next(s.vocabulary for s in model.stages if isinstance(s, CountVectorizerModel))
    assert vocabulary == ["blue", "green", "one", "red"]
