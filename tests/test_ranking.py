"""Reference ranking in blocks, its bounds and its edges."""

from inkwell.operators import ranking

SF = "/root/testdata/sf0.001"


def test_blocks_give_one_result(spark, monkeypatch):
    docs, refs = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    one = ranking.ranked_references(docs, refs).drop("scored").collect()
    cosines = ranking.best_cosines(docs, refs, "doc_id", "item_id", "text", 5000).collect()
    monkeypatch.setattr(ranking, "BLOCK", 7)
    assert key(ranking.ranked_references(docs, refs).drop("scored").collect()) == key(one)
    again = {r.id: r.s for r in ranking.best_cosines(docs, refs, "doc_id", "item_id", "text", 5000).collect()}
    assert all(abs(again[r.id] - r.s) < 1e-12 for r in cosines) and len(again) == len(cosines)
    assert max(r["rank"] or 0 for r in one) <= 5 and all(r.score is None or r.score <= r.maximum for r in one)


def test_bounds_prune_and_edges(spark):
    refs = spark.createDataFrame([(i, f"reference number{i} speaks of topic{i} at length. It has word{i} and other{i} things.") for i in range(200)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "reference number7 speaks of topic7 at length. It has word7 and other7 things."), (2, None), (3, ""), (4, "..."), (5, "reference number7 speaks of topic7 at length. It has word7 and other7 things. " + "filler " * 100)], "doc_id long, text string")
    got = {r.doc_id: r for r in ranking.ranked_references(docs, refs).where("coalesce(rank, 1) = 1").collect()}
    assert got[1].item_id == 7 and got[1].score == got[1].maximum == 1.0 and got[1].category == "high"
    assert got[5].item_id == 7 and got[5].threshold == 0.75 and got[5].scored <= 32  # others can't come near the list
    assert all(got[i].maximum == 0 and got[i]["rank"] is None and got[i].category == "none" for i in (2, 3))
    assert ranking.ranked_references(docs, refs.limit(0)).count() == 5 and ranking.ranked_references(docs.limit(0), refs).count() == 0


def test_complexity_cuts_a_text_once(spark):
    from pyspark.sql import functions as F

    from inkwell.operators import similarity

    rows = spark.createDataFrame([(1, "One model. Two data models!"), (2, ""), (3, None), (4, "?!")], "doc_id long, text string")
    got = rows.select("doc_id", similarity.complexity(F.col("text")).alias("c"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert {r.doc_id: r.c for r in got.collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
