"""Base forms put into whole texts: what leaves a document's row, and rows that repeat an id."""

from pyspark.sql import functions as F

from inkwell.operators import lemmas as M


def test_repeated_ids_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "cats cat sit"), (1, "dog dogs"), (2, "cats dogs cats"), (3, ""), (4, None), (None, "cats dog cat")], "doc_id long, text string")
    own = M.gathered(docs, F.filter(F.split("text", " "), lambda w: w != ""))
    lemmas = M.fit(own.select(F.explode(F.flatten("_ws")).alias("word")))
    got = {r.doc_id: (r.lemmas, r.n_changed) for r in M.in_texts(own, lemmas).collect()}
    # places of an id's rows are merged, as a sort of (place, base form) has them
    assert got == {1: ("cat dog cat dog sit", 2), 2: ("cat dog cat", 3), 3: ("", 0), 4: ("", 0), None: ("cat dog cat", 1)}


def test_words_that_may_change(spark):
    words = ["boxes", "men", "mice", "sit", "lives", "glass", "woman"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", M.may_change(F.col("w")).alias("may"), (F.size(M.stems(F.col("w"))) > 0).alias("ruled"))
    assert all(r.may or not (r.ruled or r.w in M.IRREGULAR) for r in got.collect())
