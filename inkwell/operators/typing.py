"""Types and fields of papers: keyword votes, chains, features and calibrated confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions import typology as K
from inkwell.functions.lexicons import STOP_WORDS
from inkwell.operators.similarity import complexity


def hits(low: Column, words: list[str]) -> Column:
    """How many of the words stand in the text."""
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def most(low: Column, table: dict[str, list[str]]) -> Column:
    """The label with most keywords in the text, the first on a tie."""
    scores = F.array(*[F.struct(hits(low, ws).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, ws) in enumerate(table.items())])
    return F.array_max(scores)["k"]


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labels by keyword votes and by first-match chains."""
    from inkwell.operators.structure import first_match

    low = F.lower(F.coalesce(text_col, F.lit("")))
    return docs.select(id_col, most(low, K.CONTENT_TYPES).alias("type_vote"), most(low, K.CONTENT_FIELDS).alias("field_vote"), first_match(low, K.TYPE_CHAIN, "empirical").alias("type_chain"), first_match(low, K.FIELD_CHAIN, "computer_science").alias("field_chain"))


def topic_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keyword densities, indicators, complexity, and the type they vote for with its calibrated confidence.

    The three voters of the ensemble agree by construction, so the vote is the densest type; texts
    without a word are ``unknown``.
    """
    text = F.coalesce(text_col, F.lit(""))
    low = F.lower(text)
    rows = docs.select(id_col, low.alias("low"), T.words(low).alias("n"), complexity(text).alias("complexity"))
    counts = {k: hits(F.col("low"), ws) for k, ws in K.TOPIC_TYPES.items()}
    rows = rows.withColumns({f"c_{k}": c for k, c in counts.items()})
    ranked = F.sort_array(F.array(*[F.col(f"c_{k}") for k in counts]), asc=False)
    best = F.array_max(F.array(*[F.struct(F.col(f"c_{k}").alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(counts)]))["k"]
    share = lambda groups: F.greatest(*[hits(F.col("low"), g) / float(len(g)) for g in groups])
    extra = {k: hits(F.col("low"), ws) / 5.0 for k, ws in K.INDICATORS.items()}
    rows = rows.withColumns({"top": F.get(ranked, F.lit(0)), "second": F.get(ranked, F.lit(1)), "predicted": F.when(F.col("n") == 0, "unknown").otherwise(best), "field": share(K.FIELD_HINTS), "approach": share(K.APPROACH_HINTS), **extra})
    strength = F.col("top") / F.greatest("n", F.lit(1))
    blur = F.when(F.col("top") > 0, F.col("second") / F.col("top")).otherwise(0.0)
    confidence = F.least(F.greatest(0.6 * strength + 0.2 * (1 - blur) + 0.2 * F.col("field"), F.lit(0.1)), F.lit(0.95))
    return rows.select(id_col, "predicted", F.when(F.col("n") == 0, 0.0).otherwise(F.round(confidence, 6)).alias("confidence"), F.round(strength, 6).alias("density"), F.round("complexity", 6).alias("complexity"), "specificity", "methodology", "analysis", "field", F.round("approach", 6).alias("approach"))


def keyword_densities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, <type>_density …)``: for each of the ten types, how many of its keywords stand in the text, by its number of words.

    A text without words, or a null one, has densities of 0.
    """
    low = F.lower(F.coalesce(text_col, F.lit("")))
    rows = docs.select(id_col, low.alias("low"), T.words(low).alias("n"))
    return rows.select(id_col, *[F.when(F.col("n") == 0, 0.0).otherwise(F.round(hits(F.col("low"), ws) / F.col("n"), 6)).alias(f"{k}_density") for k, ws in K.TOPIC_TYPES.items()])


def enhanced_words(c: Column) -> Column:
    """Words of the lower-case text without citations, stock phrases and short or stop words; known terms abbreviated."""
    c = F.lower(c)
    for p in (r"\([^)]*\)", r"\[\d+\]", r"[a-z]+ et al\."):
        c = F.regexp_replace(c, p, "")
    c = T.paraphrase(c, K.ABBREVIATIONS)
    c = T.paraphrase(c, [(p, "") for p in K.STOCK_PHRASES])
    return F.filter(F.regexp_extract_all(c, F.lit(rf"{T.WORD}+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def enhanced_normal(c: Column) -> Column:
    """The words joined by spaces, as they are written; ``lemmas.lemmatised`` gives their base forms."""
    return F.array_join(enhanced_words(c), " ")
