"""Rounds with a backend as DataFrame passes: repair and refinement of prompts, rubrics, scoring, revised drafts.

Each pass sends only the rows that still need it and is written before its result is read, so that no prompt is sent twice
when a plan is read again or an executor is lost after the write. No row is lost when the backend fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import lexicons as L
from inkwell.functions import text as T
from inkwell.functions.salvage import array_column
from inkwell.operators import replies as P
from inkwell.operators import rules as R
from inkwell.operators.tables import stored
from inkwell.sources.providers import Generator, generate

#: Opening of a chat reply that stands before its answer (fixed values).
PREAMBLE = r"(?i)^(?:sure|here(?:\s+is|'s| you go)|certainly|okay|of course|absolutely)[^\n]*\n+"
#: Passes of a repair.
PASSES = 2


def drop_preamble(c: Column) -> Column:
    """The reply without one leading line of chat; a reply of that line alone stays."""
    return F.trim(F.regexp_replace(c, PREAMBLE, ""))


def answer(c: Column) -> Column:
    """The usable part of a reply: fence and chat opening dropped, typographic characters plain."""
    return T.typographic(drop_preamble(T.strip_fence(F.coalesce(c, F.lit("")))))


def banned(rows: DataFrame, text_col: str) -> DataFrame:
    """Adds ``residual``: the terms that ask for a repair, joined by ``|``; none for a null text."""
    keyed = rows.withColumn("_all", F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    scan = R.hygiene(keyed, "_all", text_col)
    return R.hard_terms(scan, "_all").select("_all.*", F.coalesce("terms", F.lit("")).alias("residual"))


def repair_prompt(text: Column, terms: Column) -> Column:
    return F.concat(
        F.lit("Rewrite the prompt so that none of the listed items is left. Change nothing else and keep each requirement.\nListed items: "), F.regexp_replace(terms, r"\|", ", "),
        F.lit('\n\nPrompt:\n"""'), T.neutralise(text), F.lit('"""\n\nAnswer with the new prompt only, without dashes as punctuation, curly quotes, escape hatches or placeholders.'))


def repaired(rows: DataFrame, provider: Generator | None = None, text_col: str = "prompt", passes: int = PASSES) -> DataFrame:
    """Adds ``passes`` (replies used or tried), ``residual`` and ``warning``; ``text_col`` holds the repaired text.

    In each of at most ``passes`` passes the rows that still hold banned terms go to the provider; a row whose reply is empty or a sentinel keeps
    its text and is not sent again. A reply without content leaves the text but counts. Null texts are never sent.
    Ids aren't needed: repeated rows are rows of their own.
    """
    names = rows.columns
    open_ = banned(rows, text_col).withColumns({"passes": F.lit(0), "_failed": F.lit(False)})
    done = []
    for n in range(1, passes + 1):
        written = stored(open_, f"repair-{n}")
        again = (F.col("residual") != "") & ~F.col("_failed")
        done.append(written.where(~again))
        sent = generate(written.where(again).withColumn("_ask", repair_prompt(F.col(text_col), F.col("residual"))), "_ask", provider, "_reply")
        failed = R.unavailable(F.col("_reply"))
        new = answer(F.col("_reply"))
        taken = sent.withColumns({"_failed": failed, "passes": F.lit(n), text_col: F.when(failed | (F.trim(new) == ""), F.col(text_col)).otherwise(new)})
        open_ = banned(taken.select(*names, "passes", "_failed"), text_col)
        open_ = open_.select(*names, "residual", "passes", "_failed")
    last = stored(open_, "repair-last")
    for part in done:
        last = last.unionByName(part)
    found = F.split("residual", r"\|")
    warning = F.when(F.col("residual") != "", F.concat(F.lit("Could not fully remove: "), F.array_join(F.slice(found, 1, 8), ", "), F.lit(".")))
    return last.withColumn("warning", warning).drop("_failed")


def refine_prompt(text: Column, idea: Column) -> Column:
    return F.concat(
        F.lit("Review the prompt below: complete structure, exact conditions, one obligation a line, nothing two readers could take differently, nothing superfluous, plain characters.\n"),
        F.when(F.trim(F.coalesce(idea, F.lit(""))) != "", F.concat(F.lit('Original idea: """'), T.neutralise(F.trim(idea)), F.lit('"""\n'))).otherwise(""),
        F.lit('Current prompt:\n"""'), T.neutralise(text), F.lit('"""\n\nAnswer in this form:\nSCORE: <0 to 100>\nISSUES:\n- <issue>\nIMPROVED:\n<the prompt>'))


def refined(rows: DataFrame, provider: Generator | None = None, text_col: str = "prompt", idea_col: str | None = None, limit: int = 12) -> DataFrame:
    """Adds ``improved, issues, review_score, passes, residual, warning, error``.

    Issues begin with what the rules find in the original, then what the reviewer names, each once in any case, at most ``limit``. The
    improved text, or the original where a reply has none, is repaired in bounded passes. An empty text and a failed backend
    give an error and an empty result.
    """
    names = rows.columns
    text = F.trim(F.coalesce(text_col, F.lit("")))
    ask = refine_prompt(text, F.col(idea_col) if idea_col else F.lit(None).cast("string"))
    first = banned(rows, text_col).withColumnRenamed("residual", "_found")
    first = stored(first.withColumn("_ask", F.when(text != "", ask)), "refine")
    got = stored(generate(first.where("_ask IS NOT NULL"), "_ask", provider, "_reply"), "refined")
    got = got.unionByName(first.where("_ask IS NULL").withColumn("_reply", F.lit(None).cast("string")))
    error = F.when(text == "", "Nothing to refine.").when(R.unavailable(F.col("_reply")), F.coalesce("_reply", F.lit("")))
    got = got.withColumn("error", error).withColumn("_b", P.blocks(F.coalesce("_reply", F.lit(""))))
    named = F.concat(F.filter(F.split("_found", r"\|"), lambda x: x != ""), F.filter(F.coalesce("_b.issues", F.array().cast("array<string>")), lambda x: x != ""))
    once = F.filter(named, lambda x, i: F.array_position(F.transform(named, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    better = T.typographic(T.strip_fence(F.coalesce(F.when(F.coalesce("_b.improved", F.lit("")) != "", F.col("_b.improved")), text)))
    ok = F.col("error").isNull()
    got = got.withColumns({"improved": F.when(ok, better), "issues": F.when(ok, F.slice(once, 1, limit)).otherwise(F.array().cast("array<string>")), "review_score": F.when(ok, F.col("_b.score")).otherwise(F.lit(0).cast("long"))})
    fixed = repaired(got.select(*names, "improved", "issues", "review_score", "error"), provider, "improved")
    return fixed.withColumn("improved", F.coalesce("improved", F.lit("")))


ITEM = "array<struct<content:string,keywords:array<string>,weight:string,type:string>>"


def rubrics(papers: DataFrame, provider: Generator | None = None, id_col: str = "doc_id", text_col: str = "text", items: int = 7, limit: int = 12000) -> DataFrame:
    """``(id, index, content, keywords, weight, type, fallback)``: a rubric written for each paper, or the default one.

    ``items`` is kept between 3 and 12 and only asked for. Items without content go; a weight that is no positive finite number is 1. A paper without text has
    no rubric. Where no usable array comes back, the default rubric stands in and ``fallback`` says so.
    """
    n = max(3, min(12, items))
    ask = F.concat(
        F.lit(f"Write exactly {n} weighted criteria by which a strict reviewer would judge this paper: question, method, evidence, analysis, related work, writing, limits. Weights are positive and sum to 1.\n"
              'Answer with a JSON array of {"content", "keywords", "weight", "type"} only.\n\nPaper:\n"""'), F.substring(T.neutralise(F.trim(text_col)), 1, limit), F.lit('"""'))
    rows = papers.where(F.trim(F.coalesce(text_col, F.lit(""))) != "").select(id_col, ask.alias("_ask"))
    got = stored(generate(rows, "_ask", provider, "_reply").select(id_col, "_reply"), "rubrics")
    own = F.from_json(F.when(~R.unavailable(F.col("_reply")), array_column(F.col("_reply"))), ITEM)
    weight = lambda w: F.when(w.try_cast("double").isNotNull() & ~F.isnan(w.try_cast("double")) & (w.try_cast("double") > 0) & (w.try_cast("double") < float("inf")), w.try_cast("double")).otherwise(1.0)
    kind = lambda t: F.when(F.lower(F.coalesce(t, F.lit(""))) == "image", "image").otherwise("text")
    bare = lambda ks: F.filter(F.transform(F.coalesce(ks, F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: k != "")
    usable = F.filter(F.coalesce(own, F.array().cast(ITEM)), lambda i: F.trim(F.coalesce(i["content"], F.lit(""))) != "")
    made = F.transform(usable, lambda i: F.struct(F.trim(i["content"]).alias("content"), bare(i["keywords"]).alias("keywords"), weight(i["weight"]).alias("weight"), kind(i["type"]).alias("type")))
    default = F.array(*[F.struct(F.lit(c).alias("content"), F.array().cast("array<string>").alias("keywords"), F.lit(float(w)).alias("weight"), F.lit("text").alias("type")) for w, c in L.RUBRIC])
    got = got.withColumn("_m", made).withColumn("fallback", F.size("_m") == 0)
    return got.select(id_col, "fallback", F.posexplode(F.when(F.col("fallback"), default).otherwise(F.col("_m"))).alias("index", "i")).select(id_col, "index", "i.*", "fallback")


def score_items(papers: DataFrame, checklist: DataFrame, provider: Generator | None = None, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES, limit: int = 12000) -> DataFrame:
    """``checklist`` (``id, index, content, weight``) with ``score, reasoning, evidence, severity, fix, unavailable, passes``.

    One prompt for each paper and item. Items that the backend could not judge are sent again in at most ``passes`` passes in all; what fails then
    stays with a score of 0 and ``unavailable``. Replies come back to their item by its position.
    """
    # a written checklist packs to a few bytes a paper, so that its size on disk would pass for one that may be broadcast
    rows = checklist.hint("merge").join(papers.select(id_col, T.neutralise(F.col(text_col)).alias("_t")), id_col)
    seen = F.when(F.coalesce("type", F.lit("text")) == "image", "This item is about a figure, which can't be seen: judge it by what the text says of it.\n").otherwise("") if "type" in checklist.columns else F.lit("")
    ask = F.concat(F.lit("Judge the paper by one criterion.\nCriterion: "), F.col("content"), F.lit("\n"), seen, F.lit('Answer as JSON with "reasoning", "score" (0 to 100), "evidence", "location", "severity" and "fix".\n"""\n'), F.substring("_t", 1, limit), F.lit('\n"""'))
    open_, done = rows.select(id_col, "index", ask.alias("_ask")), []
    got = ["score", "reasoning", "evidence", "severity", "fix", "unavailable"]
    for n in range(1, passes + 1):
        said = P.judged(generate(open_, "_ask", provider, "_reply"), "_reply").withColumn("passes", F.lit(n))
        # only prompts that are sent again are kept: there is one for each paper and item, each with the paper's text
        said = stored(said.select(id_col, "index", F.when(F.col("unavailable"), F.col("_ask")).alias("_ask"), *got, "passes"), f"judged-{n}")
        done.append(said if n == passes else said.where("NOT unavailable"))
        open_ = said.where("unavailable").select(id_col, "index", "_ask")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    whole = whole.withColumn("score", F.when(F.col("unavailable"), 0).otherwise(F.col("score")).cast("long"))
    return checklist.hint("merge").join(whole.drop("_ask"), [id_col, "index"])


def totals(items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, total, scored, skipped, warning, error)``: weighted totals; a warning if items were left out, an error if all were."""
    got = R.rubric_total(items, [id_col])
    every = F.col("scored") + F.col("skipped")
    some = F.when((F.col("skipped") > 0) & (F.col("scored") > 0), F.format_string("%d of %d criteria could not be scored and were left out of the total.", "skipped", every))
    return got.withColumns({"warning": some, "error": F.when(F.col("scored") == 0, "AI features are not available right now. Please try again later.")})


def revised(papers: DataFrame, items: DataFrame, provider: Generator | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``plan, revised, error``: a draft rewritten by its revision plan; a paper without a weak item keeps its text."""
    plan = R.revision_plan(items, [id_col]).join(items.select(id_col, "index", "content", "fix"), [id_col, "index"])
    line = F.concat(F.col("place").cast("string"), F.lit(". ["), F.col("severity"), F.lit("] "), F.col("content"), F.when(F.coalesce("fix", F.lit("")) != "", F.concat(F.lit(" Fix: "), F.col("fix"))).otherwise(""))
    plan = plan.withColumn("_l", line).groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "_l")))["_l"], "\n").alias("plan"))
    rows = papers.join(plan, id_col, "left")
    ask = F.concat(F.lit("Revise the paper by this plan. Keep facts and citations; add none.\n\nPlan:\n"), F.col("plan"), F.lit('\n\nPaper:\n"""'), T.neutralise(F.col(text_col)), F.lit('"""'))
    rows = stored(rows.withColumn("_ask", ask), "revise")
    sent = stored(generate(rows.where("_ask IS NOT NULL"), "_ask", provider, "_reply"), "revised")
    sent = sent.unionByName(rows.where("_ask IS NULL").withColumn("_reply", F.lit(None).cast("string")))
    failed = F.col("_ask").isNotNull() & R.unavailable(F.col("_reply"))
    new = F.when(F.col("_ask").isNotNull() & ~failed, answer(F.col("_reply"))).otherwise(F.col(text_col))
    return sent.withColumns({"revised": new, "error": F.when(failed, F.coalesce("_reply", F.lit("")))}).drop("_ask", "_reply")
