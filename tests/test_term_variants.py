"""Spellings of a term: which words of a document are counted."""

from inkwell.operators import structure as X


def test_rows_of_an_id_are_one_document(spark):
    """The hyphen stands in another row than the other spelling; ids may be null; four letters are the least."""
    rows = [(1, "Data-set of all"), (1, "dataset DATASET plain words"), (2, "dataset dataset dataset"), (None, "re-use reuse reuse a-bc abc abc"), (3, None), (3, "x-ray")]
    got = X.term_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "dataset", 2, 3, 1), (None, "reuse", 2, 3, 1)]


def test_words_without_a_hyphened_spelling_are_not_shuffled(spark):
    """A word counted by the exchanges' own metrics would be one row each: here 2,000 of them, of which none has two spellings."""
    rows = [(i, " ".join(f"word{chr(97 + k % 26)}{chr(97 + i % 26)}" for k in range(100))) for i in range(20)]
    plan = X.term_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert plan.collect() == []
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(_terms" in text
