"""Prompts as columns: grounded questions, rewriting, rubric judging, section drafting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions import typology as K
from inkwell.functions.lexicons import RUBRIC, templates
from inkwell.operators.rules import unavailable
from inkwell.sources.providers import Generator, generate


def rewrite_prompt(c: Column, mode: str) -> Column:
    """A rewriting prompt; an unknown mode is the standard one."""
    mode = mode if mode in K.REWRITE_MODES else K.REWRITE_MODES[0]
    return F.concat(F.lit(f"Task: {mode}. Keep the meaning. Answer with the new text only.\n\nText:\n"), T.neutralise(F.trim(c)))


def rewrite(docs: DataFrame, mode: str, provider: Generator | None = None, text_col: str = "text") -> DataFrame:
    """Adds ``result`` and ``error``: an empty text, or a backend's sentinel, is an error."""
    rows = generate(docs.withColumn("_prompt", rewrite_prompt(F.coalesce(text_col, F.lit("")), mode)), "_prompt", provider, "_reply")
    empty = F.trim(F.coalesce(text_col, F.lit(""))) == ""
    error = F.when(empty, "no text").when(unavailable(F.col("_reply")), F.col("_reply"))
    return rows.withColumn("result", F.when(error.isNull(), F.trim("_reply"))).withColumn("error", error).drop("_prompt", "_reply")


def section_limits() -> list[tuple[str, str, int]]:
    """(type, section, words to write): the upper limit kept between 120 and 350, 250 where there is none."""
    return [(k, s, max(120, min(250 if hi is None else hi, 350))) for k, _, s, _, hi in templates()]


def section_prompts(topics: DataFrame, topic_col: str = "topic", type_col: str = "paper_type") -> DataFrame:
    """One drafting prompt for each section of each topic's type."""
    table = topics.sparkSession.createDataFrame([(k, o, s, n) for (k, o, s, _, _), (_, _, n) in zip(templates(), section_limits())], f"{type_col} string, ord int, section string, target int")
    prompt = F.format_string("Write the section '%s' of a %s paper on '%s' in about %d words.", "section", type_col, topic_col, "target")
    return topics.join(F.broadcast(table), type_col).withColumn("prompt", prompt)


def grounded_prompts(questions: DataFrame, passages: DataFrame, history: DataFrame | None = None, floor: float = 0.15) -> DataFrame:
    """``(query_id, prompt, grounded)``: ranked passages (``query_id, rank, chunk, section, score``) under a question.

    ``grounded`` says that the best passage scores at least ``floor``; ``history`` has ``query_id, rank, turn``.
    """
    piece = F.concat(F.format_string("[Passage %d", F.col("rank").cast("int")), F.when(F.col("section").isNotNull(), F.concat(F.lit(" · "), F.col("section"))).otherwise(""), F.lit("]\n"), F.col("chunk"))
    joined = passages.withColumn("_p", piece).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", "_p")))["_p"], "\n\n").alias("context"), F.max("score").alias("best"))
    rows = questions.join(joined, "query_id", "left")
    if history is not None:
        turns = history.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", "turn")))["turn"], "\n\n").alias("turns"))
        rows = rows.join(turns, "query_id", "left")
    else:
        rows = rows.withColumn("turns", F.lit(None).cast("string"))
    prompt = F.concat(F.lit("Answer from the passages; say so where they do not cover the question.\n\n"), F.coalesce(F.concat(F.lit("Recent conversation:\n"), F.col("turns"), F.lit("\n\n")), F.lit("")), F.lit("Passages:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("question"))
    return rows.select("query_id", prompt.alias("prompt"), (F.coalesce("best", F.lit(0.0)) >= floor).alias("grounded"))


def judging_prompts(papers: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 12000) -> DataFrame:
    """One prompt for each paper and rubric item; replies are parsed by ``rules.parsed_score``."""
    items = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(w).alias("weight"), F.lit(c).alias("content")) for i, (w, c) in enumerate(RUBRIC)])
    rows = papers.select(id_col, F.substring(T.neutralise(F.col(text_col)), 1, limit).alias("_t"), F.explode(items).alias("i"))
    prompt = F.concat(F.lit("Judge the paper by one criterion.\nCriterion: "), F.col("i.content"), F.lit('\nAnswer as JSON with "reasoning", "score" (0 to 100), "evidence", "location", "severity" and "fix".\n"""\n'), F.col("_t"), F.lit('\n"""'))
    return rows.select(id_col, "i.*", prompt.alias("prompt"))


def framed(idea: Column, framework: str, clauses: Column) -> Column:
    """A prompt outline in a framework's parts, with the conditional clauses an idea calls for."""
    parts = K.FRAMEWORKS.get(framework, K.FRAMEWORKS["rtf"])
    return F.concat(F.lit("".join(f"{p}: …\n" for p in parts)), F.lit("Idea: "), T.typographic(idea), F.lit("\n"), F.array_join(clauses, "\n"))


def overviews(docs: DataFrame, provider: Generator | None = None, questions: int = 4, id_col: str = "doc_id", text_col: str = "text", chunks: int = 6, limit: int = 4000) -> DataFrame:
    """``(id, summary, questions, error)``: what a document is about, and questions that it answers.

    The prompt holds the first ``chunks`` chunks, cut at ``limit`` characters. A reply without a summary part is its own summary, up to 400
    characters; list items count as questions if they end in a question mark or have four words. A document without
    text, and a failed backend, give an error.
    """
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("chunk_id") < chunks, F.struct("chunk_id", "chunk")))), lambda c: c["chunk"]), "\n\n")
    heads = T.chunks(docs.where(F.col(text_col).isNotNull()), id_col, text_col).groupBy(id_col).agg(F.substring(first, 1, limit).alias("_head"))
    rows = docs.select(id_col).distinct().join(heads, id_col, "left")
    ask = F.concat(F.lit(f"Say in two or three sentences what the document that begins below is about. Then list exactly {questions} questions that it answers.\nAnswer in this form:\nSUMMARY: <summary>\nQUESTIONS:\n- <question>\n\nDocument:\n"), T.neutralise(F.col("_head")))
    said = generate(rows.select(id_col, ask.alias("_ask")), "_ask", provider, "_reply")
    reply = F.coalesce("_reply", F.lit(""))
    none = F.col("_ask").isNull()
    error = F.when(none, "No document loaded.").when(unavailable(F.col("_reply")), reply)
    part = F.trim(F.regexp_extract(reply, r"(?is)SUMMARY:\s*(.+?)(?:\n\s*QUESTIONS:|$)", 1))
    listed = F.filter(F.transform(F.split(reply, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^(?:[-*•]|\d+[.)])"))
    asked = F.filter(F.transform(listed, lambda x: F.trim(F.regexp_replace(x, r"^[-•*\d.)\s]+", ""))), lambda q: (q != "") & (q.endswith("?") | (T.words(q) >= 4)))
    ok = F.col("error").isNull()
    said = said.withColumn("error", error)
    return said.select(id_col, F.when(ok, F.when(part != "", part).otherwise(F.substring(F.trim(reply), 1, 400))).otherwise("").alias("summary"), F.when(ok, F.slice(asked, 1, questions)).otherwise(F.array().cast("array<string>")).alias("questions"), "error")
