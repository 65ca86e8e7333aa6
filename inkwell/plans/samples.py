"""Inline rows that exercise operators the synthetic documents leave idle, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAPERS = [
    (-1, "# Abstract\nIn recent years deep models have become common. However, this paper aims to close a research gap. We conducted a survey of 120 users. Results show a gain of 12 % (Smith et al., 2020). We conclude that more work is needed.\n\n1. Introduction\nMachine Learning (ML) is popular. ML is used by NASA and the data-set is large. The dataset grows. A dataset helps [1, 2]. Moreover, it is important to note that we delve into the realm of seamless tools.\n\nMethods\nThe model was tested. We measured accuracy carefully. The sample was clearly shown to be perfect.\n\n## Results:\nStudies show that it outperforms others. Results indicate 3 times more speed. According to Jones (2019) it is fine.\n\nMethodology\nFurther methods were described."),
    (-2, "Introduction\nWe propose a novel approach for the first time. The the API is used. Application Interface (API) is defined later. Advanced Program Interface (API) differs.\n\nResults\nbody one\n\nMethodology\nbody two of the case study and literature review\n\nCase Analysis\nbody three"),
    (-3, "i think we recieve the data , Then im sure you cant seperate it . Dont worry, ive definately seen it. If applicable, use several tools properly as needed. TBD — see 2020 – 2024 – later ${NAME} and find the total, then classify and rate."),
    (-4, "One short line of text that repeats the very same words here. Something else stands in between the two of them now. One short line of text that repeats the very same words here. A closing sentence of eight words stands right here."),
    (-5, ""),
    (-6, None),
]

REFERENCES = [
    (1, "Deep Learning for Text", [("Ada", "Lovelace"), ("Alan Mathison", "Turing")], "2020", "Journal of Tests", "", "10.1234/abc", ""),
    (2, "Deep learning, for text!", [("Ada", "Lovelace")], "2019", "", "Preprint House", "", "http://x.org/1"),
    (3, "Graph Methods in Large Scale Retrieval Systems", [("G.", "One"), ("H.", "Two"), ("I.", "Three"), ("J.", "Four"), ("K.", "Five"), ("L.", "Six"), ("M.", "Seven")], "", "", "", "", ""),
    (4, "", [], "2001", "Nowhere", "", "", ""),
    (5, "Graph methods in large-scale retrieval systems", [("G.", "One")], "2021", "Proc. Q", "", "10.5555/zz.9", ""),
    (6, "", [("", "Solo")], "", "", "", "", "http://y.org"),
]

ENTRIES = [
    (1, "[1] Lovelace A. Deep learning for text. 2020. doi 10.1234/ABC."),
    (2, "2. One G. Graph methods in large scale retrieval systems, 2021, 10.9999/other"),
    (3, "Completely fabricated entry about nothing known anywhere"),
    (4, "(4) Deep text learning models"),
]

ITEMS = [
    (1, 0, 80.0, 0.25, "Minor", False), (1, 1, 40.0, 0.75, "Major", False), (1, 2, 10.0, 1.0, "Critical", True), (1, 3, 50.0, 0.5, "", False), (1, 4, 90.0, 0.1, "None", False),
    (2, 0, 80.0, 0.0, "", False), (2, 1, 40.0, -3.0, "None", False), (3, 0, 70.0, None, "Major", False), (4, 0, 5.0, 1.0, "Critical", True),
]

REPLIES = [
    (1, 'Sure: {"reasoning": "fine", "score": 87.9}'), (2, "score: 51-60 band, final score = 73"), (3, "The score is about 64 of 100"), (4, "no number"), (5, '{"score": 250}'), (6, None),
    (7, "Error: backend down"), (8, "Groq error 500"), (9, "An error: not at the start"),
]

PAIRS = [
    (-1, "The model was tested on data. We measured accuracy.", "The model was tested on data. We measured accuracy."),
    (-2, "Deep networks learn features. They need data.", "Shallow trees split features quickly here. They need little data to work."),
    (-3, "alpha beta gamma", "delta epsilon"),
    (-4, "", "words only here"),
]


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, list):
        return "[" + ", ".join("{'given': " + literal(g) + ", 'family': " + literal(f) + "}" for g, f in v) + "]" if v else "CAST([] AS STRUCT(given VARCHAR, family VARCHAR)[])"
    return "'" + v.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A VALUES table of the rows, with its column names."""
    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({names}))"


def with_papers(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents and the inline papers."""
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame(PAPERS, "doc_id long, text string"))


#: The same in SQL.
DOCS = f"docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {values(PAPERS, 'doc_id, text')})"
