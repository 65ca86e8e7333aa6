"""Overviews, backends in order, banded evaluation and folds of forests."""

from inkwell.operators import models as M
from inkwell.operators import prompts as P
from inkwell.sources.providers import OFFLINE, InOrder


class Says:
    def __init__(self, reply, up=True):
        self.reply, self.up = reply, up

    def available(self):
        return self.up

    def generate(self, prompts):
        if isinstance(self.reply, Exception):
            raise self.reply
        return [self.reply.get(p, "") if isinstance(self.reply, dict) else self.reply for p in prompts]


def docs(spark):
    return spark.createDataFrame([(1, "One sentence here. Another one follows it."), (2, ""), (3, None), (4, "word " * 5000)], "doc_id long, text string")


def test_overviews(spark):
    reply = "SUMMARY: It is about\nsentences.\nQUESTIONS:\n- Why so?\n- short one\n2) how many of them are there\n* And when?\n- Who?\n- Where?"
    got = {r.doc_id: r for r in P.overviews(docs(spark), Says(reply)).collect()}
    assert got[1].summary == "It is about\nsentences." and got[1].questions == ["Why so?", "how many of them are there", "And when?", "Who?"] and got[1].error is None
    assert got[3].error == "No document loaded." and got[3].summary == "" and got[3].questions == []
    assert got[2].error == "No document loaded." and got[4].error is None
    assert {r.summary for r in P.overviews(docs(spark).where("doc_id = 4"), Says("z" * 900)).collect()} == {"z" * 400}
    assert {r.error for r in P.overviews(docs(spark)).collect()} == {OFFLINE, "No document loaded."}


def test_backends_in_order():
    both = InOrder([("first", Says({"a": "A", "b": "Groq error 1"})), ("second", Says({"b": "B"})), ("third", Says(ValueError("x"), up=False))])
    assert both.generate(["a", "b", "c"]) == ["A", "B", "Error: backend 'third': x"]
    assert both.status() == {"first": True, "second": True, "third": False}
    assert InOrder([]).generate(["a"]) == [OFFLINE]


def test_bands(spark):
    bands = [("High", 0.7, None), ("Medium", 0.4, 0.7), ("Low", 0.2, 0.4), ("None", None, 0.2)]
    rows = [("p", "High", "High", 0.9, 1.0, 0.8), ("p", "High", "Low", 0.7, 3.0, 0.4), ("p", None, "Medium", None, None, 0.4), ("q", "None", "None", 0.5, 1.0, None), ("q", "x", "Other", 0.5, 1.0, 0.1)]
    got = {r.task: r for r in M.evaluate_bands(spark.createDataFrame(rows, "task string, predicted string, expected string, confidence double, seconds double, score double"), bands, ["task"]).collect()}
    assert (round(got["p"].accuracy, 6), round(got["p"].mean_confidence, 6), got["p"].mean_seconds, round(got["p"].score_accuracy, 6), got["p"].rows) == (0.333333, 0.8, 2.0, 0.666667, 3)
    assert (got["q"].accuracy, got["q"].score_accuracy) == (0.5, 0.0)


def test_paraphrases_are_told_from_originals_with_pairs_in_one_fold(spark):
    texts = [(i, f"the study shows that the data of trial {i % 7} are important and the results of the analysis were found early") for i in range(60)]
    from inkwell.functions.typology import PARAPHRASES

    pairs = M.paraphrase_pairs(spark.createDataFrame(texts, "doc_id long, text string"), PARAPHRASES)
    got = M.fold_accuracies(pairs, "label", folds=2, group="doc_id", trees=10, features=200).collect()
    by = {(r.fold, r.label): r.rows for r in got}
    assert len(got) == 4 and by[0, "original"] == by[0, "paraphrased"] and sum(by.values()) == 120
    assert sum(r.correct for r in got) == 120
