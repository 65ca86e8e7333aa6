"""The language model against a plain version, and the sum of its probabilities."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkwell.operators import kneser

TEXTS = ["the cat sat on the mat .", "the dog sat on the cat", "a dog ate the mat , the end", "cat", "the the the"]


def plain(texts, order, d=0.75):
    """p(w | context) by the definition."""
    rows = [["<s>"] * (order - 1) + t.split() for t in texts]
    top = Counter(tuple(r[i : i + order]) for r in rows for i in range(len(r) - order + 1))
    tables = {order: top}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    words = tables[1]

    def p(w, context):
        if not context:
            total, kinds = sum(words.values()), len(words)
            return max(words[(w,)] - d, 0) / total + d * kinds / total / (kinds + 1)
        own = {g: c for g, c in tables[len(context) + 1].items() if g[:-1] == context}
        low = p(w, context[1:])
        if not own:
            return low
        return max(own.get((*context, w), 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * low

    return p, sorted({w for r in rows for w in r[order - 1 :]})


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities(spark, order):
    sents = spark.createDataFrame([(i, 0, t) for i, t in enumerate(TEXTS)], "doc_id long, pos int, sent string")
    model, (p, words) = kneser.fit(sents, order), plain(TEXTS, order)
    contexts = [c[-(order - 1) :] for c in (("<s>", "<s>"), ("<s>", "the"), ("on", "the"), ("sat", "on"), ("never", "seen"), ("never", "the"))]
    asked = [(w, *c[::-1]) for c in contexts for w in [*words, "unknown"]]
    names = ", ".join(["w string", *(f"h{k} string" for k in range(1, order))])
    got = {tuple(r)[: order]: r.q for r in kneser.surprisals(spark.createDataFrame(asked, names), model).select("w", *(f"h{k}" for k in range(1, order)), F.exp(-F.col("nll")).alias("q")).collect()}
    for c in contexts:
        assert sum(got[w, *c[::-1]] for w in [*words, "unknown"]) == pytest.approx(1)
        for w in [*words, "unknown"]:
            assert got[w, *c[::-1]] == pytest.approx(p(w, c))


def test_document_scores(spark):
    docs = spark.createDataFrame([(1, "The cat sat on the mat. The dog sat on the cat."), (2, None), (3, ""), (4, "One"), (5, "zyx wvu tsr qpo nml kji"), (6, "the " * 600)], "doc_id long, text string")
    sents = spark.createDataFrame([(i, 0, t) for i, t in enumerate(TEXTS * 5)], "doc_id long, pos int, sent string")
    got = {r.doc_id: r for r in kneser.document_perplexity(docs, kneser.fit(sents)).collect()}
    assert set(got) == {1, 5, 6} and got[1].n_sentences == 2 and got[1].perplexity < got[5].perplexity and got[1].spread > 0 == got[5].spread
    p, _ = plain(TEXTS * 5, 2)
    want = math.exp(-sum(math.log(p("the", (h,))) for h in ["<s>", *["the"] * 511]) / 512)
    assert got[6].perplexity == pytest.approx(want, abs=1e-3)
    assert kneser.document_perplexity(docs.limit(0), kneser.fit(sents.limit(0))).count() == 0
