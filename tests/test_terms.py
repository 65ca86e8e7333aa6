"""Terms as whole words: what the plain pattern finds, without running it over every text."""

import re

from pyspark.sql import functions as F

from inkwell.functions import lexicons as L
from inkwell.operators import rules as R


def test_intents_are_those_of_the_plain_patterns(spark):
    texts = ["Extract the total, then classify it.", "totals of a subtotal", "How many_x; how many?", "RATE: 3", "", None, "sort  into", "Sort into groups"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = R.intents(docs)
    for r in got.collect():
        low = (texts[r.doc_id] or "").lower()
        for k, ws in L.INTENTS.items():
            assert r[k] == any(re.search(rf"(?<!\w){re.escape(w)}(?!\w)", low) for w in ws), (low, k)
    assert "Contains(" in got._jdf.queryExecution().analyzed().toString() or "Contains" in got._jdf.queryExecution().executedPlan().toString()


def test_found_terms(spark):
    row = spark.range(1).select(R.found_terms(F.lit("as needed, properly"), ["properly", "as needed", "need"]).alias("t")).first()
    assert row.t == ["as needed", "properly"]
