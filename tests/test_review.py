"""Rounds with deterministic backends, some of which fail."""

import json
import os

from inkwell.functions import lexicons as L
from inkwell.operators import review as E
from inkwell.sources.providers import Scrubber, WordJudge


class Logged:
    """Writes a line for each prompt to a file of the task's own, then answers by ``reply``."""

    def __init__(self, folder, reply):
        self.folder, self.reply = str(folder), reply

    def generate(self, prompts):
        with open(f"{self.folder}/{os.getpid()}-{os.urandom(4).hex()}", "w") as f:
            f.write("".join(json.dumps(p) + "\n" for p in prompts))
        return [self.reply(p) for p in prompts]

    def sent(self):
        return [json.loads(line) for name in os.listdir(self.folder) for line in open(f"{self.folder}/{name}")]


def prompts(spark):
    rows = [(1, "A clean prompt."), (2, "Use TBD and leverage it."), (3, "Essentially, do it — now, as needed."), (4, None), (5, ""), (2, "Use TBD and leverage it.")]
    return spark.createDataFrame(rows, "id long, prompt string")


def test_repairs_only_what_needs_it(spark, tmp_path):
    backend = Logged(tmp_path, Scrubber.rewritten)
    got = sorted(E.repaired(prompts(spark), backend).collect(), key=lambda r: (r.id, r.prompt or ""))
    assert [(r.id, r.passes, r.residual, r.warning) for r in got] == [(1, 0, "", None), (2, 1, "", None), (2, 1, "", None), (3, 1, "", None), (4, 0, "", None), (5, 0, "", None)]
    assert got[0].prompt == "A clean prompt." and got[4].prompt is None and "leverage" not in got[1].prompt and "—" not in got[3].prompt
    assert len(backend.sent()) == 3


def test_stubborn_backend_is_asked_twice_and_warned_of(spark, tmp_path):
    backend = Logged(tmp_path, lambda p: "Sure, here it is:\nPlease utilize TBD")
    got = E.repaired(prompts(spark).where("id = 3"), backend).collect()[0]
    assert (got.prompt, got.passes, got.residual) == ("Please utilize TBD", 2, "placeholder token|utilize")
    assert got.warning == "Could not fully remove: placeholder token, utilize."
    assert len(backend.sent()) == 2


def test_failing_backend_loses_no_row(spark, tmp_path):
    backend = Logged(tmp_path, lambda p: "Error: down")
    got = E.repaired(prompts(spark), backend)
    assert got.count() == 6
    kept = got.where("id = 2").collect()[0]
    assert (kept.prompt, kept.passes) == ("Use TBD and leverage it.", 1) and "placeholder token" in kept.warning
    assert len(backend.sent()) == 3, "a failed row is not sent again"
    assert E.repaired(prompts(spark)).count() == 6


def test_empty_table(spark):
    none = prompts(spark).limit(0)
    assert E.repaired(none, Scrubber()).count() == 0
    assert E.refined(none, Scrubber()).count() == 0


def test_refinement(spark, tmp_path):
    def reply(p):
        if "Current prompt:" not in p:
            return Scrubber.rewritten(p)
        return "SCORE: 140\nISSUES:\n- No role\n- no ROLE\n- LEVERAGE\nIMPROVED:\nAct as an editor. Utilize care."

    got = {r.id: r for r in E.refined(prompts(spark), Logged(tmp_path, reply)).collect()}
    assert got[2].issues == ["leverage", "placeholder token", "No role"] and got[2].review_score == 100
    assert got[2].improved == "Act as an editor.  care." and got[2].passes == 1 and got[2].error is None
    assert got[4].error == got[5].error == "Nothing to refine." and got[4].improved == "" and got[4].issues == []
    down = {r.id: r for r in E.refined(prompts(spark)).collect()}
    assert down[1].error.startswith("AI features") and down[1].improved == "" and down[5].error == "Nothing to refine."


def papers(spark):
    return spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, " "), (4, None)], "doc_id long, text string")


class Rubric:
    def generate(self, prompts):
        made = json.dumps([{"content": " Is it new? ", "keywords": [" a ", ""], "weight": 0.7, "type": "Image"}, {"content": "", "weight": 1}, {"content": "Is it right?", "weight": -3}])
        return [f"As in [12]:\n```json\n{made}\n```" if "alpha" in p else "no array" for p in prompts]


def test_rubrics(spark):
    got = sorted(E.rubrics(papers(spark), Rubric()).collect(), key=lambda r: (r.doc_id, r["index"]))
    assert [(r["index"], r.content, r.keywords, r.weight, r.type, r.fallback) for r in got if r.doc_id == 1] == [(0, "Is it new?", ["a"], 0.7, "image", False), (1, "Is it right?", [], 1.0, "text", False)]
    assert [r.content for r in got if r.doc_id == 2] == [c for _, c in L.RUBRIC] and all(r.fallback for r in got if r.doc_id == 2)
    assert {r.doc_id for r in got} == {1, 2}


def test_items_that_fail_are_sent_again_and_come_back_by_position(spark, tmp_path):
    class Flaky:
        """Fails for the second criterion of beta always, for all of alpha the first time."""

        def __init__(self, folder):
            self.folder = str(folder)

        def generate(self, prompts):
            out = []
            for p in prompts:
                if "beta" in p and L.RUBRIC[1][1] in p:
                    out.append("Error: down")
                    continue
                mark = f"{self.folder}/{len(p)}-{sum(map(ord, p))}"
                if "alpha" in p and not os.path.exists(mark):
                    open(mark, "w").close()
                    out.append("Groq error 429")
                else:
                    out.append('{"reasoning": "r", "score": 60, "severity": "minor", "fix": "more"}')
            return out

    items = E.score_items(papers(spark), E.rubrics(papers(spark)), Flaky(tmp_path))
    rows = {(r.doc_id, r["index"]): r for r in items.collect()}
    assert len(rows) == 14
    assert {rows[1, i].passes for i in range(7)} == {2} and {rows[1, i].score for i in range(7)} == {60}
    assert rows[2, 1].unavailable and rows[2, 1].score == 0 and rows[2, 0].passes == 1
    total = {r.doc_id: r for r in E.totals(items).collect()}
    assert (total[1].total, total[1].scored, total[1].warning, total[1].error) == (60.0, 7, None, None)
    assert (total[2].total, total[2].skipped) == (60.0, 1) and total[2].warning.startswith("1 of 7")
    draft = {r.doc_id: r for r in E.revised(papers(spark), items, type("B", (), {"generate": lambda self, ps: ["Certainly:\nnew text" for _ in ps]})()).collect()}
    assert draft[1].revised == "new text" and draft[1].plan.startswith("1. [Minor]") and draft[1].plan.count("\n") == 5
    assert draft[4].revised is None and draft[4].error is None and draft[3].revised == " "
    down = {r.doc_id: r for r in E.totals(E.score_items(papers(spark), E.rubrics(papers(spark)))).collect()}
    assert down[1].error is not None and down[1].total == 0


def test_checklists_are_not_broadcast(spark):
    # one reply for all papers: its table packs to some bytes a paper, its seven items and their criteria don't
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('the method of paper ', id) AS text")
    items = E.score_items(docs, E.rubrics(docs), WordJudge())
    assert "BroadcastHashJoin" not in items._jdf.queryExecution().executedPlan().toString()
    assert E.totals(items).where("scored = 7").count() == 500


def test_offline_judge():
    prompt = 'Judge.\nCriterion: Clear writing matters\nAnswer\n"""\nThe writing is clear\n"""'
    assert json.loads(WordJudge.judged(prompt))["score"] == 66
