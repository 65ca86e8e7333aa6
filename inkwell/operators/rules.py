"""Rule engines: grammar, hygiene, intents, review scores and plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import lexicons as L
from inkwell.functions import text as T


def whole(word: str) -> str:
    import re

    return rf"(?i)(?<!{T.WORD}){re.escape(word)}(?!{T.WORD})".replace("\\ ", " ")


def grammar_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Changes of each kind, counted on the original text.

    The rule for a lone i never changes anything, as its guard compares without case. A space before
    punctuation that is followed by a space and a letter is the one shape the punctuation rules change.
    """
    c = F.col(text_col)
    kinds = {k: sum((F.regexp_count(c, F.lit(whole(w))) for w, _, kind in L.GRAMMAR_WORDS if kind == k), F.lit(0)).cast("long") for k in ("Grammar", "Spelling")}
    punctuation = sum((F.regexp_count(c, F.lit(p)) for p in L.GRAMMAR_PUNCTUATION), F.lit(0)).cast("long")
    return docs.select(id_col, kinds["Grammar"].alias("grammar"), kinds["Spelling"].alias("spelling"), punctuation.alias("punctuation"))


def grammar_changes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, rule, kind, position, original, corrected, context)`` of every change, positions in the original text from 0.

    Places come from the pieces between matches: a match begins where all pieces and matches before it end. Rules only
    run on texts in which some rule matches.
    """
    c = F.col("text")
    rules = [(whole(w), kind, w, fix) for w, fix, kind in L.GRAMMAR_WORDS] + [(p, "Punctuation", None, None) for p in L.GRAMMAR_PUNCTUATION]
    rows = docs.select(id_col, F.col(text_col).alias("text"))
    rows = rows.where(c.rlike("|".join([f"(?i)(?<!{T.WORD})(?:{'|'.join(w for w, _, _ in L.GRAMMAR_WORDS)})(?!{T.WORD})", *L.GRAMMAR_PUNCTUATION])))

    def placed(pattern: str) -> Column:
        found, pieces = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern)
        pairs = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("match"))
        start = F.struct(F.array().cast("array<struct<position:int,original:string>>").alias("done"), F.lit(0).alias("at"))

        def add(acc: Column, z: Column) -> Column:
            begin = acc["at"] + F.length(z["piece"])
            one = F.struct(begin.alias("position"), z["match"].alias("original"))
            return F.struct(F.array_append(acc["done"], one).alias("done"), (begin + F.length(z["match"])).alias("at"))

        return F.when(F.size(found) > 0, F.aggregate(pairs, start, add, lambda a: a["done"])).otherwise(F.array().cast("array<struct<position:int,original:string>>"))

    each = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(kind).alias("kind"), F.lit(fix).cast("string").alias("fix"), placed(p).alias("found")) for i, (p, kind, _, fix) in enumerate(rules)])
    rows = rows.select(id_col, "text", F.explode(each).alias("r")).select(id_col, "text", "r.rule", "r.kind", "r.fix", F.explode("r.found").alias("m"))
    spaced = F.regexp_replace(F.col("m.original"), r"^\s+([.!?,;:])\s*", "$1 ")
    context = T.context(c, F.col("m.position"), F.length("m.original"))
    return rows.select(id_col, "rule", "kind", F.col("m.position").cast("long").alias("position"), F.col("m.original").alias("original"), F.coalesce("fix", spaced).alias("corrected"), context.alias("context"))


def grammar_corrected(c: Column) -> Column:
    """The text after all rules in order."""
    for w, fix, _ in L.GRAMMAR_WORDS:
        c = F.regexp_replace(c, whole(w), fix)
    for p in L.GRAMMAR_PUNCTUATION:
        c = F.regexp_replace(c, p, "$1 $2")
    return c


def found_terms(low: Column, terms: list[str]) -> Column:
    """Sorted terms that stand in lower-case text as whole words."""
    return F.array_compact(F.array(*[F.when(stands(low, t), F.lit(t)) for t in sorted(terms)]))


def stands(low: Column, term: str) -> Column:
    """Whether a term stands in lower-case text as a whole word; the pattern only runs where its characters stand at all."""
    return low.contains(term) & low.rlike(whole(term))


def hygiene(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Signs and terms of machine prose and unfinished text; a pattern only runs where its characters stand at all."""
    # a column of its own: inside the functions of hard_terms, lower() would run again for each term
    docs, c, low = docs.withColumn("_low", F.lower(text_col)), F.col(text_col), F.col("_low")
    any_of = lambda t, parts: reduce(Column.__or__, [t.contains(p) for p in parts])
    tells = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(L.AI_TELLS), F.lit(0)))), "|")
    ranges = F.regexp_replace(c, r"\d\s*–\s*\d", "")
    return docs.select(
        id_col,
        c.contains("—").alias("em_dash"),
        (c.contains("–") & ranges.rlike(r"\s–|–\s")).alias("en_dash"),
        (any_of(c, L.PLACEHOLDER_SIGNS) & c.rlike(L.PLACEHOLDER)).alias("placeholders"),
        F.when(any_of(low, L.AI_TELL_STEMS), tells).when(c.isNotNull(), "").alias("ai_tells"),
        F.array_join(found_terms(low, L.ESCAPE_HATCHES), "|").alias("escape_hatches"),
        F.array_join(found_terms(low, L.HOLLOW_ADVERBS), "|").alias("hollow"),
        F.array_join(found_terms(low, L.VAGUE_QUANTIFIERS), "|").alias("vague"),
    )


def hard_terms(scan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Violations that ask for a repair, sorted."""
    split = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
    fixed = F.array_compact(F.array(F.when(F.col("em_dash"), "em dash"), F.when(F.col("en_dash"), "en dash used as punctuation"), F.when(F.col("placeholders"), "placeholder token")))
    return scan.select(id_col, F.array_join(F.array_sort(F.array_distinct(F.concat(fixed, split(F.col("ai_tells")), split(F.col("escape_hatches"))))), "|").alias("terms"))


def hygiene_issues(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 12) -> DataFrame:
    """``(id, n_issues, terms)``: number of issues and the first ``limit`` of them, for documents that have any."""
    rows = hard_terms(hygiene(docs.where(F.col(text_col).isNotNull()), id_col, text_col), id_col).where("terms <> ''")
    found = F.split("terms", r"\|")
    return rows.select(id_col, F.size(found).cast("long").alias("n_issues"), F.array_join(F.slice(found, 1, limit), "|").alias("terms"))


def intents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which conditional clauses a task's words call for."""
    rows = docs.select(id_col, F.coalesce(F.lower(text_col), F.lit("")).alias("_low"))
    return rows.select(id_col, *[reduce(Column.__or__, [stands(F.col("_low"), t) for t in ws]).alias(k) for k, ws in L.INTENTS.items()])


def unavailable(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = low == ""
    for p in L.UNAVAILABLE:
        out = out | low.startswith(p)
    return out


def severity(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.when(low.startswith("critical"), "Critical")
    for s in ("major", "minor", "none"):
        out = out.when(low.startswith(s), s.capitalize())
    return out.otherwise("")


def clamp_score(c: Column) -> Column:
    """0 to 100, truncated; 0 for what is no finite number."""
    d = c.try_cast("double")
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    return F.when(finite, F.greatest(F.lit(0), F.least(F.lit(100), F.when(F.abs(d) > 1000, F.signum(d) * 1000).otherwise(d).cast("int")))).otherwise(0).cast("long")


def parsed_score(raw: Column) -> Column:
    """The score of a judge's reply: a JSON object's, else the last ``score: n``, else the last number after score."""
    obj = F.get_json_object(F.regexp_extract(raw, r"(?s)\{[^{}]*\"score\"[^{}]*\}", 0), "$.score")
    strict = F.regexp_extract_all(raw, F.lit(r'(?i)"?score"?\s*[:=]\s*(\d{1,3})'), F.lit(1))
    loose = F.regexp_extract_all(raw, F.lit(r"(?i)score\D{0,6}(\d{1,3})"), F.lit(1))
    last = F.when(F.size(strict) > 0, F.element_at(strict, -1)).when(F.size(loose) > 0, F.element_at(loose, -1))
    return clamp_score(F.coalesce(obj, last))


def covered_items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Items of the default rubric (``id, index, score, weight, severity, unavailable``) scored by the share of their words that a text has.

    Under 20 percent an item is critical, under 40 major, under 60 minor. A text that is null or blank can't be judged: its items score 0
    and are unavailable.
    """
    have = T.content_tokens(F.col(text_col), L.REFERENCE_STOP_WORDS)
    blank = F.trim(F.coalesce(text_col, F.lit(""))) == ""

    def item(i: int, weight: float, content: str) -> Column:
        want = T.content_tokens(F.lit(content), L.REFERENCE_STOP_WORDS)
        share = F.floor(100 * F.size(F.array_intersect(want, "_have")) / F.greatest(F.size(want), F.lit(1)))
        return F.struct(F.lit(i).alias("index"), F.when(F.col("_blank"), 0.0).otherwise(share.cast("double")).alias("score"), F.lit(float(weight)).alias("weight"))

    rows = docs.select(id_col, have.alias("_have"), blank.alias("_blank"))
    rows = rows.select(id_col, "_blank", F.explode(F.array(*[item(i, w, c) for i, (w, c) in enumerate(L.RUBRIC)])).alias("i")).select(id_col, "i.*", F.col("_blank").alias("unavailable"))
    level = F.when(F.col("score") < 20, "Critical").when(F.col("score") < 40, "Major").when(F.col("score") < 60, "Minor").otherwise("None")
    return rows.select(id_col, "index", "score", "weight", level.alias("severity"), "unavailable")


def rubric_total(items: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean of scored items (``score, weight, unavailable``); a plain mean if all weights are 0.

    A negative or non-finite weight counts 0, a missing one 1. Unavailable items are left out.
    """
    w = F.col("weight").try_cast("double")
    w = F.when(F.col("weight").isNull() | w.isNull(), 1.0).when(F.isnan(w) | (w < 0) | (F.abs(w) == float("inf")), 0.0).otherwise(w)
    rows = items.withColumns({"_w": w, "_on": ~F.coalesce("unavailable", F.lit(False))})
    on = lambda c: F.sum(F.when(F.col("_on"), c).otherwise(0.0))
    got = rows.groupBy(*keys).agg(on(F.col("score") * F.col("_w")).alias("sw"), on(F.col("_w")).alias("sumw"), F.avg(F.when(F.col("_on"), F.col("score"))).alias("plain"), F.count_if("_on").alias("scored"), F.count_if(~F.col("_on")).alias("skipped"))
    return got.select(*keys, F.round(F.when(F.col("sumw") > 0, F.col("sw") / F.col("sumw")).otherwise(F.coalesce("plain", F.lit(0.0))), 6).alias("total"), "scored", "skipped")


def revision_plan(items: DataFrame, keys: list[str], limit: int = 6) -> DataFrame:
    """Weak items, the severest and most weighty first."""
    rank = F.when(F.col("severity") == "Critical", 0).when(F.col("severity") == "Major", 1).when(F.col("severity") == "Minor", 2).when(F.col("severity") == "None", 4).otherwise(3)
    rows = items.where(~F.coalesce("unavailable", F.lit(False)) & (F.col("severity").isin("Critical", "Major", "Minor") | (F.col("score") < 60)))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(rank, F.desc(F.coalesce("weight", F.lit(0.0)) * (100 - F.col("score"))), "index"))
    return rows.withColumn("place", order.cast("long")).where(F.col("place") <= limit).select(*keys, "place", "index", "severity", "score")
