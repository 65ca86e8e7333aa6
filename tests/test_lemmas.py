"""Base forms against a list made by hand, and both ways of joining them."""

from pyspark.sql import functions as F

from inkwell.operators import lemmas as M

#: word, base form
BY_HAND = """
networks network; studies study; methods method; analyses analysis; classes class; boxes box; churches church; wishes wish; knives knife; wolves wolf; women woman; men man; buses bus; houses house; cities city
theories theory; children child; criteria criterion; indices index; matrices matrix; mice mouse; leaves leaf; lives life; quizzes quizz; taxes tax; bases basis; hypotheses hypothesis; authors author; papers paper; data data
class class; virus virus; analysis analysis; thesis thesis; gas gas; process process; processes process; losses loss; biases bias; series series; batches batch; brushes brush; axes ax; firemen fireman; loaves loaf
queries query; vertices vertex; phenomena phenomenon; teeth tooth; feet foot; tokens token; unseens unseens; species species; branches branch; proxies proxy; shelves shelf
"""
#: Singular words that the corpus of the test holds twice.
LEXICON = "network study method class box church wish knife wolf woman man bus house city theory leaf life quizz tax author paper virus gas process loss bias batch brush ax fireman loaf query token branch proxy shelf".split()


def pairs():
    return [tuple(p.split()) for line in BY_HAND.strip().splitlines() for p in line.split(";")]


def table(spark):
    words = [w for w, _ in pairs()] + LEXICON * 2
    return M.fit(spark.createDataFrame([(w,) for w in words] + [(None,)], "word string"))


def test_list_made_by_hand(spark):
    assert len(pairs()) >= 50
    rows = spark.createDataFrame(pairs(), "word string, wanted string")
    assert M.with_lemmas(rows, table(spark)).where("lemma <> wanted").collect() == []


def test_few_by_broadcast_and_the_rest_by_shuffle(spark):
    rows, lemmas = spark.createDataFrame(pairs() + [(None, None)], "word string, wanted string"), table(spark)
    got = M.with_lemmas(rows, lemmas, frequent=3)
    assert got.columns == ["word", "wanted", "lemma"]
    assert got.count() == len(pairs()) + 1
    assert got.where("lemma <> wanted OR (lemma IS NULL AND wanted IS NOT NULL)").collect() == []


def test_one_occurrence_is_no_evidence(spark):
    words = spark.createDataFrame([("zorbs",), ("zorb",), ("glims",), ("glim",), ("glim",)], "word string")
    assert [tuple(r)[:2] for r in M.fit(words).collect()] == [("glims", "glim")]


def test_order_repeats_and_documents_without_words(spark):
    docs = spark.createDataFrame([(1, "papers cite papers by authors"), (2, ""), (3, None), (4, "papers")], "doc_id long, text string")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    got = {r.doc_id: r.lemmas for r in M.lemmatised(docs, words, table(spark)).collect()}
    assert got == {1: "paper cite paper by author", 2: "", 3: "", 4: "paper"}


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "word string")
    assert M.fit(none).count() == 0
    assert M.with_lemmas(none, M.fit(none)).columns == ["word", "lemma"]
