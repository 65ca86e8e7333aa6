import random

from pyspark.sql import functions as F

from inkwell.functions.salvage import balanced, best_array, best_object
from inkwell.operators import models, prompts, replies
from inkwell.operators.bibliography import REFERENCE
from inkwell.operators.similarity import keep_first, rerank


def test_brackets_in_strings():
    assert list(balanced('x {"a": "}{", "b": {"c": 1}} y {"d": 2} {')) == ['{"a": "}{", "b": {"c": 1}}', '{"d": 2}']
    assert list(balanced('{"a": "\\"}"}')) == ['{"a": "\\"}"}']
    assert best_object('{"score": 1} {"reasoning": "r", "score": 2} {"x": 3}', ("reasoning", "score")) == '{"reasoning": "r", "score": 2}'
    assert best_object(None, ("score",)) is None and best_object("{bad} none", ("score",)) is None
    assert best_array('[1] [{"a": 1}, {"a": 2}]') == '[{"a": 1}, {"a": 2}]'


def test_judged(spark):
    rows = spark.createDataFrame([(1, 'ok {"reasoning": "good {x}", "score": "87.9", "severity": "minor issue"} end'), (2, "score: 40"), (3, "Error: down"), (4, None)], "i long, reply string")
    got = {r.i: r for r in replies.judged(rows).collect()}
    assert (got[1].score, got[1].reasoning, got[1].severity, got[1].parsed) == (87, "good {x}", "Minor", True)
    assert (got[2].score, got[2].parsed, got[2].unavailable) == (40, False, False)
    assert got[3].unavailable and got[4].unavailable and got[4].score == 0


def test_grammar_reply(spark):
    rows = spark.createDataFrame([(1, 'a {"corrected_text": "Fine.", "changes": [{"type": "Spelling", "original": "x"}, {"type": "Tense"}]}'), (2, "no")], "i long, reply string")
    got = {r.i: r for r in replies.grammar_reply(rows).withColumn("s", replies.change_statistics(F.col("changes"))).collect()}
    assert got[1].corrected == "Fine." and (got[1].s.total, got[1].s.spelling, got[1].s.grammar) == (2, 1, 1)
    assert got[2].corrected is None


def test_blocks(spark):
    r = spark.createDataFrame([("ISSUES:\n- one\n2. two\nnote\nSCORE: 88\nIMPROVED: better\ntext",)], "t string").select(replies.blocks(F.col("t")).alias("b")).first().b
    assert r.issues == ["one", "two"] and r.score == 88 and r.improved == "better\ntext"


def test_citations(spark):
    rows = [(1, "T", [], "2020", "J", "", "", ""), (2, "", [], "", "", "", "", "")]
    refs = spark.createDataFrame(rows, REFERENCE).withColumn("topic", F.col("id"))
    got = {r.topic: r.citations for r in replies.citations(refs, "topic").collect()}
    assert got == {1: "(2020). T. J.", 2: "No verified references were found."}


def test_prompts(spark):
    docs = spark.createDataFrame([(1, 'say """hi"""'), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in prompts.rewrite(docs, "Shorten").collect()}
    assert got[1].result is None and got[1].error.startswith("AI features") and got[2].error == "no text"
    q = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id long, question string")
    p = spark.createDataFrame([(1, 2, "b", None, 0.1), (1, 1, "a", "Results", 0.2)], "query_id long, rank int, chunk string, section string, score double")
    out = {r.query_id: r for r in prompts.grounded_prompts(q, p).collect()}
    assert "[Passage 1 · Results]\na\n\n[Passage 2]\nb" in out[1].prompt and out[1].grounded and not out[2].grounded
    assert prompts.judging_prompts(docs).count() == 14
    topics = spark.createDataFrame([("x", "review")], "topic string, paper_type string")
    assert prompts.section_prompts(topics).count() == 9


def test_order_helpers(spark):
    rows = spark.createDataFrame([("k", 1, None, 1), ("k", 2, 0.5, 2), ("k", 3, 0.9, 3)], "q string, i long, similarity double, place long")
    assert [r.i for r in rerank(rows, ["q"], "i").orderBy("rank").collect()] == [3, 2, 1]
    assert keep_first(rows, F.col("q"), "place").first().i == 1


def test_models(spark, tmp_path):
    rng = random.Random(1)
    words = {"x": ["apple", "pear", "plum"], "y": ["stone", "iron", "steel"]}
    rows = [(i, " ".join(rng.choices(words[k], k=8)), k) for i in range(60) for k in [rng.choice("xy")]]
    data = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    model = models.fit(data, "kind", features=64)
    models.save(model, str(tmp_path / "m"))
    got = models.predict(models.load(str(tmp_path / "m")), data).join(data, "doc_id")
    r = models.evaluate(got, "kind").first()
    assert r.accuracy == 1.0 and 0.5 < r.mean_confidence <= 1
    bayes = models.fit(data, "kind", "bayes", features=64)
    vote = models.soft_vote([model, bayes], data).join(data, "doc_id")
    assert vote.where("predicted = kind").count() == 60
    assert models.predict(models.fit(data, "kind", "svm", features=64), data).join(data, "doc_id").where("predicted = kind").count() == 60
    pairs = models.paraphrase_pairs(data, [("apple", "fruit")])
    assert pairs.count() == 120
