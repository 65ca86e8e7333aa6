"""Folds, the kernel's approximation, calibration and the vote."""

import random
from collections import Counter

import numpy as np
import pytest

from inkwell.operators import voting


def test_folds_are_exact(spark):
    rows = [(i % 900, "hot" if i % 3 else f"l{i % 7}") for i in range(2000)] + [(5, None)] * 4
    frame = spark.createDataFrame(rows, "doc_id long, label string")
    got = voting.stratified_folds(frame, "label").collect()
    assert len(got) == 2004
    count, whole = Counter((r.label, r.fold) for r in got), Counter(x for _, x in rows)
    for label, n in whole.items():
        own = [count[label, f] for f in range(5)]
        assert sum(own) == n and max(own) - min(own) <= 1


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 20))
    kernel = np.exp(-0.05 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    error = [np.abs(f.of(x) @ f.of(x).T - kernel).max() for f in (voting.Fourier.draw(20, w, 0.05) for w in (64, 4096))]
    assert error[1] < 0.1 and error[1] < error[0] / 3


def test_vote_is_calibrated(spark):
    """Texts that overlap: a third of the words is noise, and every tenth label is wrong."""
    rng = random.Random(8)
    texts = []
    for i in range(240):
        k = i % 2
        words = [rng.choice("alpha beta gamma delta".split() if (rng.random() < 0.62) == bool(k) else "one two three four".split()) for _ in range(12)]
        texts.append((i, " ".join(words), str(k if i % 10 else 1 - k)))
    frame = spark.createDataFrame(texts, "doc_id long, text string, y string").repartition(2)
    vote = voting.fit(frame.where("doc_id < 160"), "y", features=64, width=64, gamma=0.05, trees=20)
    rows = {r.member: r for r in voting.scores(vote, frame.where("doc_id >= 160"), "y").collect()}
    assert set(rows) == {"forest", "bayes", "svm", "raw_svm", "vote"} and all(r.rows == 80 for r in rows.values())
    assert rows["svm"].brier < rows["raw_svm"].brier and rows["vote"].accuracy > 0.6 and rows["vote"].brier < 0.5
    probabilities = vote.probabilities(frame).collect()
    assert all(sum(r[c]) == pytest.approx(1) for r in probabilities for c in ("forest", "bayes", "svm", "vote"))
    assert {r.predicted for r in vote.predict(frame).collect()} == {"0", "1"}
    with pytest.raises(ValueError):
        voting.fit(frame.where("y = '1'"), "y")
