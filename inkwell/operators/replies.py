"""Model replies as rows: grammar changes, judged criteria, question lists, revision blocks, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.salvage import object_column
from inkwell.operators.bibliography import formatted
from inkwell.operators.rules import clamp_score, parsed_score, severity, unavailable

CHANGE = "type string, message string, original string, corrected string, position int, context string, rule_id string, severity string"


def grammar_reply(rows: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Adds ``corrected`` and ``changes`` of a grammar reply; a reply without the object gives nulls."""
    obj = F.from_json(object_column("changes", "corrected_text")(F.col(reply_col)), f"corrected_text string, changes array<struct<{', '.join(p.replace(' ', ':', 1) for p in CHANGE.split(', '))}>>")
    return rows.withColumn("_o", obj).withColumns({"corrected": F.col("_o.corrected_text"), "changes": F.col("_o.changes")}).drop("_o")


def change_statistics(changes: Column) -> Column:
    """Counts of changes: spelling and style by their types, all others grammar."""
    of = lambda word: F.size(F.filter(changes, lambda c: F.lower(c["type"]).contains(word)))
    total = F.coalesce(F.size(changes), F.lit(0))
    return F.struct(total.alias("total"), of("spelling").alias("spelling"), of("style").alias("style"), (total - of("spelling") - of("style")).alias("grammar"))


def judged(rows: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Adds ``score, reasoning, evidence, severity, fix, parsed, unavailable`` to judging replies."""
    obj = F.from_json(object_column("reasoning", "score")(F.col(reply_col)), "reasoning string, score string, evidence string, location string, severity string, fix string")
    text = lambda c: F.trim(F.coalesce(F.col(f"_o.{c}"), F.lit("")))
    parsed = F.col("_o").isNotNull()
    rows = rows.withColumn("_o", obj)
    return rows.withColumns({
        "score": F.when(parsed, clamp_score(F.col("_o.score"))).otherwise(parsed_score(F.col(reply_col))),
        "reasoning": F.when(parsed, text("reasoning")).otherwise(F.substring(F.trim(F.coalesce(reply_col, F.lit(""))), 1, 400)),
        "evidence": text("evidence"), "severity": severity(F.col("_o.severity")), "fix": text("fix"), "parsed": parsed,
        "unavailable": ~parsed & unavailable(F.col(reply_col)),
    }).drop("_o")


def bullets(c: Column, limit: int = 5) -> Column:
    """Lines of a bulleted or numbered list, marks stripped."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    marked = F.transform(F.split(c, "\n"), lambda x: x.rlike(r"^\s*(?:[-*•]|\d+[.)])\s*\S"))
    kept = F.filter(F.arrays_zip(lines.alias("x"), marked.alias("m")), lambda z: z.m)
    return F.slice(F.transform(kept, lambda z: z.x), 1, limit)


def blocks(c: Column) -> Column:
    """ISSUES, SCORE and IMPROVED parts of a refinement reply."""
    part = lambda name, nxt: F.trim(F.regexp_extract(c, rf"(?is)\b{name}\s*:\s*(.*?)(?=\n\s*(?:{nxt})\s*:|$)", 1))
    return F.struct(bullets(part("ISSUES", "SCORE|IMPROVED"), 12).alias("issues"), clamp_score(F.regexp_extract(part("SCORE", "ISSUES|IMPROVED"), r"\d+", 0)).alias("score"), part("IMPROVED", "ISSUES|SCORE").alias("improved"))


def citations(refs: DataFrame, key: str, style: str = "APA", rows: int = 8) -> DataFrame:
    """Up to ``rows`` formatted references of each topic, or an honest note where there is none."""
    made = refs.withColumn("_f", formatted(style)).groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.when(F.coalesce("title", F.lit("")) != "", F.struct("id", "_f"))))["_f"], 1, rows).alias("_c"))
    return made.select(key, F.when(F.size("_c") > 0, F.array_join("_c", "\n")).otherwise("No verified references were found.").alias("citations"))
