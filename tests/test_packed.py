"""The packed bigram model gives what the joins of ``kneser`` give, in any chunks and buckets."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import kneser, packed

ODD = ["", " ", "One", "one two.  three four five six.\n\nSeven eight! nine", "Ünï größe… 日本 😀 a_b x\x0by. Z z z z", "?! . . . a", "the " * 700 + ". " + "cat " * 600, "no end here", "a b c d e. f"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    words = [*"the cat sat on mat , dog ate end".split(), *(f"w{k}" for k in range(40))]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(1, 9))) + rng.choice(".!?")
    texts = [*ODD, *(" ".join(sentence() for _ in range(rng.randint(1, 8))) for _ in range(80))]
    return spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string").repartition(3).cache()


def test_words_are_those_of_the_column(spark):
    want = [[int(packed._hash(w.encode())) for w in r.w] for r in spark.createDataFrame(list(enumerate(ODD)), "i long, t string").orderBy("i").select(kneser.word_array(F.col("t")).alias("w")).collect()]
    hashes, lens, runs, text = packed.tokens(pa.array(["dropped", *ODD]).slice(1))
    by = np.bincount(text, lens, minlength=len(ODD)).astype(int)
    assert [x.tolist() for x in np.split(hashes, np.cumsum(by)[:-1])] == want
    sents = [s for t in ODD for s in packed_sentences(spark, t)]
    assert [(n, r) for n, r in zip(lens.tolist(), runs.tolist())] == sents


def packed_sentences(spark, text):
    rows = T.sentences(spark.createDataFrame([(0, text)], "doc_id long, text string")).orderBy("pos").select(F.size(kneser.word_array(F.col("sent"))).alias("n"), T.words(F.col("sent")).alias("r")).collect()
    return [(r.n, r.r) for r in rows if r.n]


@pytest.mark.parametrize("chunk, bucket", [(3_000_000, 2_000_000), (200, 30)])
def test_chunks_and_buckets_meet_the_joins(docs, monkeypatch, chunk, bucket):
    monkeypatch.setattr(packed, "CHUNK", chunk)
    monkeypatch.setattr(packed, "BUCKET", bucket)
    monkeypatch.setattr(packed, "ROW", 1)
    want = sorted(map(tuple, kneser.document_perplexity(docs, kneser.fit(T.sentences(docs))).collect()))
    assert sorted(map(tuple, packed.corpus_perplexity(docs).collect())) == want and len(want) > 80
    assert packed.corpus_perplexity(docs.limit(0)).count() == 0


def test_no_row_for_a_word(spark, docs, monkeypatch):
    """What is written grows with the distinct pairs of a chunk: no step has a row for each word."""
    written = []
    monkeypatch.setattr(packed, "stored", lambda frame, name: written.append(name) or frame.localCheckpoint())
    got = packed.corpus_perplexity(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and written == ["perplexity-chunks", "perplexity-pairs", "perplexity-words"]


def test_packed_numbers():
    for x in ([], [0], [1, 2**63, 2**64 - 1], [5] * 1000):
        x = np.array(x, np.uint64)
        assert packed.unpack(packed.pack(x)).tolist() == x.tolist()
    most, rows, columns = packed.plan(10**13)
    assert most > packed.CHUNK and round(most / (rows * columns)) >= packed.ROW
