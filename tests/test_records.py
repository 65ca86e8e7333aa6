"""Pages as references, rubric items by covered words, small tables by a document's type."""

from inkwell.functions import lexicons as L
from inkwell.operators import bibliography as B
from inkwell.operators import rules as R
from inkwell.operators import structure as X

HEAD = ('<title>Deep\n  learning &amp;lt; text</title><meta name="citation_author" content="Ada M. Lovelace"><meta name="author" content="Solo"><meta name="author" content=" ">'
        '<meta name="citation_publication_date" content="12 May 2021"><meta name="citation_journal_title" content="Tests &amp; Trials"><meta name="citation_doi" content="doi:10.1234/Ab.c.">')


def test_pages_as_references(spark):
    pages = spark.createDataFrame([(1, "HTTPS://Www.Example.org:80/a?b", HEAD), (2, None, None), (3, "no url", "<title></title>")], "page_id long, url string, html string")
    got = {r.id: r for r in B.cited_pages(pages).collect()}
    one = got[1]
    assert (one.title, one.year, one.journal, one.publisher, one.doi, one.url) == ("Deep learning &lt; text", "2021", "Tests & Trials", "www.example.org:80", "10.1234/Ab.c", "HTTPS://Www.Example.org:80/a?b")
    assert [(a.given, a.family) for a in one.authors] == [("Ada M.", "Lovelace"), ("", "Solo")]
    for other in (got[2], got[3]):
        assert (other.title, other.authors, other.year, other.journal, other.publisher, other.doi) == ("", [], "", "", "", "")
    assert B.cited_pages(pages.limit(0)).count() == 0
    assert B.cited_pages(pages).select(B.formatted("APA").alias("a")).first().a == "Lovelace, A. M., & Solo (2021). Deep learning &lt; text. Tests & Trials. https://doi.org/10.1234/Ab.c"


def test_items_by_covered_words(spark):
    whole = " ".join(c for _, c in L.RUBRIC)
    docs = spark.createDataFrame([(1, whole), (2, None), (3, " "), (4, "zzz"), (4, "zzz")], "doc_id long, text string")
    items = R.covered_items(docs)
    got = {}
    for r in items.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[1]) == len(L.RUBRIC) and all((r.score, r.severity, r.unavailable) == (100.0, "None", False) for r in got[1])
    assert all(r.unavailable and r.score == 0 for d in (2, 3) for r in got[d])
    assert len(got[4]) == 2 * len(L.RUBRIC) and all((r.score, r.severity) == (0.0, "Critical") for r in got[4])
    totals = {r.doc_id: (r.total, r.scored, r.skipped) for r in R.rubric_total(items, ["doc_id"]).collect()}
    assert totals[1] == (100.0, len(L.RUBRIC), 0) and totals[2] == (0.0, 0, len(L.RUBRIC))


def test_tables_by_type(spark):
    docs = spark.createDataFrame([(1, "a systematic literature review of prior work", 5), (2, None, 6)], "doc_id long, text string, paper_type int")
    got = {(r.doc_id, r.paper_type, r.n) for r in X.of_type(docs, [("review", 1), ("review", 2), ("empirical", 3)], "n int").collect()}
    assert got == {(1, "review", 1), (1, "review", 2), (2, "empirical", 3)}
