"""Properties over generated texts."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import similarity as S


@pytest.fixture(scope="module")
def generated(spark):
    rng = random.Random(11)
    words = ["model", "data", "graph", "Übung", "naïve", "the", "of", "result", "x"]
    rows = [(i, ". ".join(" ".join(rng.choices(words, k=rng.randrange(1, 14))) for _ in range(rng.randrange(1, 9))) + ".") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def test_cosines_lie_in_the_unit_interval(generated):
    refs = generated.limit(10).withColumnRenamed("doc_id", "item_id")
    r = S.corpus_scores(generated, refs).agg(F.min("score"), F.max("score")).first()
    assert 0 <= r[0] and r[1] <= 100.000001
    assert S.corpus_scores(generated, refs).where("doc_id < 10 and score < 99.9999").join(generated.where(F.size(T.analysed(F.col("text"))) > 0), "doc_id").count() == 0


def test_fusion_depends_on_order_only(generated):
    base = generated.select(F.lit(1).alias("q"), F.col("doc_id").alias("i"), F.pmod(F.xxhash64("doc_id"), F.lit(97)).cast("double").alias("lexical"), F.pmod(F.xxhash64("text"), F.lit(89)).cast("double").alias("d"))
    a = S.fuse(base.select("q", "i", "lexical"), base.select("q", "i", F.col("d").alias("dense")), ["q"], "i")
    b = S.fuse(base.select("q", "i", (F.col("lexical") * 3 + 1).alias("lexical")), base.select("q", "i", F.exp(F.col("d") / 50).alias("dense")), ["q"], "i")
    assert [r.i for r in a.orderBy("rank").collect()] == [r.i for r in b.orderBy("rank").collect()]


def test_chunks_hold_every_sentence(generated):
    got = {r.doc_id: r.c for r in T.chunks(generated, target_words=20).groupBy("doc_id").agg(F.collect_list("chunk").alias("c")).collect()}
    for r in T.sentences(generated).collect():
        assert any(r.sent in c for c in got[r.doc_id])


def test_every_word_with_a_letter_has_a_syllable(generated):
    w = generated.select(F.explode(T.tokens(F.col("text"))).alias("w")).where(F.col("w").rlike("[A-Za-z]"))
    assert w.where(T.syllables(F.col("w")) < 1).count() == 0
