"""The search keeps only what may be among the best; words are summed and scored in batches."""

import math
from collections import Counter

from pyspark.sql import functions as F

from inkwell.operators import similarity as S


def test_search_blocks_of_many_queries(spark, monkeypatch):
    """Ties, ids that repeat, nulls and strips smaller than k: the same as a sort of all products."""
    rows = [(i % 70, [math.sin(i // 3), math.cos(i // 3)]) for i in range(120)] + [(200, None), (201, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for i in sorted({i for i, a in rows if a and len(a) == 2 and i % 5 == 0}):
        for a in [a for j, a in rows if j == i][:1]:
            best = sorted((-round(a[0] * b[0] + a[1] * b[1], 6) + 0.0, j) for j, b in rows[:120] if j != i)[:4]
            want += [(i, j, -s) for s, j in best]
    first = spark.createDataFrame([r for n, r in enumerate(rows[:120]) if r[0] % 5 == 0 and r[0] not in [x[0] for x in rows[:n]]], v.schema)
    for sizes in ({}, {"SEARCH_BLOCK": 5, "VECTOR_BLOCK": 30, "STRIP": 3}, {"STRIP": 7}):
        for name, size in sizes.items():
            monkeypatch.setattr(S, name, size)
        got = [(r.query_id, r.vec_id, -r.similarity) for r in S.dense_topk(first, v).collect()]
        assert sorted((i, s + 0.0, j) for i, j, s in got) == sorted((i, -s + 0.0, j) for i, j, s in want)


def test_word_sums_and_cosines(spark):
    docs = spark.createDataFrame([(1, "red green red"), (1, "blue red"), (2, "green"), (3, None), (4, "else")], "doc_id long, text string")
    own = S.own_words(docs, "doc_id", F.col("text"))
    assert sorted(map(tuple, S.word_sums(own).collect())) == [("blue", 1, 1), ("else", 1, 1), ("green", 2, 2), ("red", 3, 1)]
    weights, asked = {"red": 2.0, "green": 1.0, "blue": 3.0}, {7: {"red": 0.6, "green": 0.8}, 8: {"blue": 1.0}}
    got = {(r.query_id, r.doc_id): r.lexical for r in S.cosines(own, weights, asked, "doc_id", "long").collect()}
    w = {t: n * weights[t] for t, n in Counter(["red", "green", "red", "blue", "red"]).items()}
    norm = math.sqrt(sum(x * x for x in w.values()))
    assert got == {(7, 1): round((w["red"] * 0.6 + w["green"] * 0.8) / norm, 6), (8, 1): round(w["blue"] / norm, 6), (7, 2): 0.8}
