"""Readability, tone, machine-style signals and claims, one row per document or sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import lexicons as L
from inkwell.functions import text as T

PASSIVE = rf"(?i)(?<!{T.WORD})(?:{'|'.join(L.BE_FORMS)})\s+(?:[a-z]+ly\s+)?(?:[a-z]+ed|{'|'.join(L.IRREGULAR_PARTICIPLES)})(?!{T.WORD})"


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def word_stats(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Adds ``words``, ``syllables``, ``hard`` (3 or more syllables) and ``letters`` of a text column."""
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x)))).cast("long")
    # each is computed once and passed on: a filter on plain columns would be moved below them and count everything twice
    once = lambda rows, *cs: rows.select("*", F.inline(F.array(F.struct(*cs))))
    names, c = rows.columns, F.col(column)
    rows = once(rows, T.ascii_words(c).alias("_words"))
    rows = once(rows, F.regexp_replace(F.lower("_words"), "[0123456789]+", "").alias("_letters"), count(F.col("_words"), " ").alias("words"))
    rows = once(rows, T.syllable_marks(F.col("_letters")).alias("_marks"))
    # two letters beyond ASCII stand as ASCII ones in the words
    exact = F.length(F.regexp_replace(c, f"[^{T.LETTERS}{T.LETTERS.upper()}]+", ""))
    stats = F.struct(
        "words",
        count(F.col("_marks"), "a").alias("syllables"),
        # three marks at the beginning of a word
        ((F.length("_marks") - F.length(F.regexp_replace("_marks", "(?<!a)aaa", ""))) / 3).cast("long").alias("hard"),
        F.when(c.contains("\u0130") | c.contains("\u212A"), exact).otherwise(F.length("_letters") - F.col("words")).cast("long").alias("letters"),
    )
    return rows.select(*names, F.inline(F.array(stats)))


def readability(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Flesch, Flesch-Kincaid and Fog scores; documents without words or sentences have null scores."""
    rows = docs.select(id_col, F.col(text_col).alias("text"))
    rows = rows.select("*", F.inline(F.array(F.struct(T.sentence_count(F.col("text")).cast("long").alias("sentences")))))
    rows = word_stats(rows, [id_col], "text").where("words > 0 and sentences > 0")
    w, s, y, h = (F.col(c).cast("double") for c in ("words", "sentences", "syllables", "hard"))
    flesch = F.lit(206.835) - 1.015 * w / s - 84.6 * y / w
    band = F.when(flesch >= 90, "very easy").when(flesch >= 80, "easy").when(flesch >= 70, "fairly easy").when(flesch >= 60, "standard").when(flesch >= 50, "fairly difficult").when(flesch >= 30, "difficult").otherwise("very difficult")
    return rows.select(id_col, "sentences", "words", "syllables", "hard", "letters", F.round(flesch, 6).alias("flesch"), F.round(0.39 * w / s + 11.8 * y / w - 15.59, 6).alias("grade"), F.round(0.4 * (w / s + 100 * h / w), 6).alias("fog"), F.round(w / 200, 6).alias("read_minutes"), F.round(w / 130, 6).alias("speak_minutes"), band.alias("band"))


def sentence_difficulty(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = word_stats(T.sentences(docs, id_col, text_col), [id_col, "pos"], "sent").where("words > 0")
    rate = F.col("syllables") / F.col("words")
    level = F.when((F.col("words") > 30) | (rate > 1.9), "hard").when((F.col("words") > 22) | (rate > 1.6), "medium").otherwise("easy")
    return rows.select(id_col, F.col("pos").cast("long").alias("pos"), "words", "syllables", level.alias("level"))


def passive_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 10) -> DataFrame:
    """The first ``limit`` sentences of each document in the passive voice."""
    return first_of(T.sentences(docs, id_col, text_col).where(F.col("sent").rlike(PASSIVE)), id_col, limit)


def first_of(rows: DataFrame, id_col: str, limit: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit).withColumn("pos", F.col("pos").cast("long"))


def long_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", over: int = 25, limit: int = 10) -> DataFrame:
    rows = T.sentences(docs, id_col, text_col).withColumn("n_words", T.words(F.col("sent")).cast("long")).where(F.col("n_words") > over)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n_words"), "pos"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit).select(id_col, F.col("pos").cast("long").alias("pos"), "n_words", "rank")


def boundary(phrase: str) -> str:
    """A phrase between non-letters; a phrase that ends in a space needs only the left boundary."""
    import re

    body = re.escape(phrase).replace("\\ ", " ")
    return rf"(?<![a-z]){body}" + ("" if phrase.endswith(" ") else "(?![a-z])")


def bounded_count(t: Column, phrase: str) -> Column:
    """Bounded occurrences in lower-case text; the pattern only runs where the phrase stands at all."""
    return F.when(t.contains(phrase), F.regexp_count(t, F.lit(boundary(phrase)))).otherwise(0)


def tone_rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicons: dict[str, list[str]] = L.TONE, min_words: int = 20) -> DataFrame:
    """``(id, category, hits, per_1000)`` for documents of at least ``min_words`` words."""
    rows = docs.select(id_col, F.concat(F.lit(" "), F.lower(text_col), F.lit(" ")).alias("t"), T.words(F.col(text_col)).alias("n")).where(F.col("n") >= min_words)
    counted = [F.struct(F.lit(k).alias("category"), sum((bounded_count(F.col("t"), p) for p in ps), F.lit(0)).cast("long").alias("hits")) for k, ps in lexicons.items()]
    return rows.select(id_col, "n", F.explode(F.array(*counted)).alias("c")).select(id_col, "c.category", "c.hits", F.round(F.col("c.hits") * 1000.0 / F.col("n"), 6).alias("per_1000"))


def tone_examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 8) -> DataFrame:
    """The first overclaiming and over-hedged (two or more hedges) sentences of each document."""
    low = F.lower("sent")
    hits = lambda k: sum((bounded_count(low, p) for p in L.TONE[k]), F.lit(0))
    rows = T.sentences(docs, id_col, text_col).select(id_col, "pos", F.when(hits("Overclaiming") >= 1, "overclaim").alias("a"), F.when(hits("Hedging") >= 2, "overhedged").alias("b"))
    rows = rows.select(id_col, "pos", F.explode(F.filter(F.array("a", "b"), lambda x: x.isNotNull())).alias("kind"))
    rank = F.row_number().over(Window.partitionBy(id_col, "kind").orderBy("pos"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit).withColumn("pos", F.col("pos").cast("long"))


def phrase_count(t: Column, p: str) -> Column:
    """Occurrences of a phrase as a token before a space, comma or dot in padded text; copies are only made where it stands."""
    n = sum((((F.length(t) - F.length(F.replace(t, F.lit(f" {p}{e}")))) / (len(p) + 2)).cast("int") for e in (" ", ",", ".")), F.lit(0))
    return F.when(t.contains(f" {p}"), n).otherwise(0)


def machine_style(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[str] = L.AI_PHRASES, min_words: int = 25) -> DataFrame:
    """Burstiness, word variety, stock phrases, their blend and the noisy-OR verdict of this signal alone.

    A phrase isn't counted if a longer listed phrase that contains it was found.
    """
    sents = F.filter(F.transform(T.sentence_array(F.col(text_col)), lambda s: T.words(s)), lambda n: n > 0)
    got = F.filter(T.tokens(F.lower(text_col)), lambda w: w.rlike("[a-z]"))
    rows = docs.select(id_col, F.concat(F.lit(" "), F.lower(text_col), F.lit(" ")).alias("t"), sents.alias("lens"), F.size(got).cast("long").alias("words"), F.size(F.array_distinct(got)).cast("long").alias("distinct_words"))
    rows = rows.where((F.col("words") >= min_words) & (F.size("lens") >= 2))
    rows = rows.withColumns({f"p{i}": phrase_count(F.col("t"), p) for i, p in enumerate(phrases)})
    longer = {i: [j for j, q in enumerate(phrases) if q != p and p in q] for i, p in enumerate(phrases)}
    hits = sum((F.when(sum((F.col(f"p{j}") for j in longer[i]), F.lit(0)) > 0, 0).otherwise(F.col(f"p{i}")) if longer[i] else F.col(f"p{i}") for i in range(len(phrases))), F.lit(0))
    n = F.size("lens").cast("double")
    total = F.aggregate("lens", F.lit(0), lambda a, x: a + x).cast("double")
    squares = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x).cast("double")
    mean = total / n
    cv = F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0))) / mean
    rows = rows.withColumns({"hits": hits.cast("long"), "sentences": F.size("lens").cast("long"), "cv": cv, "variety": F.col("distinct_words") / F.col("words")})
    u, d, p = clamp(1 - F.col("cv") / 0.6), clamp((0.6 - F.col("variety")) / 0.4), clamp(F.col("hits") / F.col("sentences") / 0.8)
    h = 0.45 * u + 0.10 * d + 0.45 * p
    rows = rows.withColumn("heuristic", F.round(100 * h, 6)).withColumn("score", F.round(100 * (1 - F.pow(1 - F.least(h, F.lit(0.999999)), F.lit(0.7))), 6))
    verdict = F.when(F.col("score") >= 65, "likely machine").when(F.col("score") >= 35, "mixed").otherwise("likely human")
    return rows.select(id_col, "sentences", "words", "distinct_words", "hits", F.round("cv", 6).alias("cv"), "heuristic", "score", verdict.alias("verdict"))


def noisy_or(signals: list[tuple[Column, float]]) -> Column:
    """100 * (1 - prod((1 - f / 100) ^ w)) over the signals that are present."""
    out = F.lit(1.0)
    for f, w in signals:
        out = out * F.when(f.isNull(), 1.0).otherwise(F.pow(1 - clamp(f / 100), F.lit(w)))
    return 100 * (1 - out)


def perplexity_score(p: Column) -> Column:
    """100 at a perplexity of 10 or less, 0 at 60 or more, linear between; null where there is none."""
    # perplexities have four places, so that halves of the last place are common: tenths are made whole before they are rounded, which the
    # last bit of a quotient (54.949999999999996 for 54.95) doesn't change
    return F.round(100 * clamp((60 - p) / 50) * 10) / 10


def citation_markers(c: Column) -> Column:
    return sum((F.regexp_count(c, F.lit(p)) for p in L.CITATIONS), F.lit(0))


def has_citation(c: Column) -> Column:
    return citation_markers(c) > 0


def is_claim(c: Column) -> Column:
    return c.rlike(f"(?i){L.STRONG_CLAIM}") | c.rlike(L.NUMBER_CLAIM)


def citation_density(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(id_col, citation_markers(F.col(text_col)).cast("long").alias("markers"), T.words(F.col(text_col)).cast("long").alias("n_words"))
    return rows.withColumn("per_1000", F.round(F.col("markers") * 1000.0 / F.greatest("n_words", F.lit(1)), 6))


def section_citations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Citation markers of each section that has words: ``(id, section, markers, n_words, per_1000)``."""
    rows = T.sections(docs, id_col, text_col).select(id_col, F.col("name").alias("section"), citation_markers(F.col("body")).cast("long").alias("markers"), T.words(F.col("body")).cast("long").alias("n_words"))
    return rows.where("n_words > 0").withColumn("per_1000", F.round(F.col("markers") * 1000.0 / F.col("n_words"), 6))


def uncited_claims(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 25) -> DataFrame:
    rows = T.sentences(docs, id_col, text_col)
    return first_of(rows.where(is_claim(F.col("sent")) & ~has_citation(F.col("sent"))), id_col, limit)


def contributions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 10) -> DataFrame:
    return first_of(T.sentences(docs, id_col, text_col).where(F.col("sent").rlike(f"(?i){L.CONTRIBUTION}")), id_col, limit)


def grade_band(grade: Column, low: float, high: float) -> Column:
    return F.when(grade < low, "simpler than your target").when(grade > high, "more complex than your target").otherwise("on target")


def to_target(n: Column, low: Column, high: Column) -> Column:
    return F.when(n < low, "under").when(n > high, "over").otherwise("ok")


def perplexity_spread(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Mean, spread and 0-to-100 score of sentence perplexities (``perplexity``) by document; null where none is known."""
    rows = scored.groupBy(id_col).agg(F.avg("perplexity").alias("mean"), F.stddev_pop("perplexity").alias("spread"))
    return rows.withColumn("score", perplexity_score(F.col("mean")))


#: What each analysis needs of a document.
GATES = {"ai_style": "needs 25 words and 2 sentences", "tone": "needs 20 words", "cohesion": "needs 2 paragraphs", "repetition": "needs 2 sentences of 8 words"}


def gate_errors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, analysis, error)`` for each analysis that a document is too short for; such documents have no result rows."""
    c = F.coalesce(text_col, F.lit(""))
    lens = F.filter(F.transform(T.sentence_array(c), lambda s: T.words(s)), lambda n: n > 0)
    got = F.size(F.filter(T.tokens(F.lower(c)), lambda w: w.rlike("[a-z]")))
    long = lambda parts: F.size(F.filter(parts, lambda p: T.words(p) >= 5))
    blocks, lines = long(F.split(F.trim(c), r"\n\s*\n")), long(F.split(F.trim(c), "\n"))
    fails = {"ai_style": (got < 25) | (F.size(lens) < 2), "tone": T.words(c) < 20, "cohesion": F.when(blocks < 2, lines).otherwise(blocks) < 2, "repetition": F.size(F.filter(lens, lambda n: n >= 8)) < 2}
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(k).alias("analysis"), F.lit(GATES[k]).alias("error"))) for k, bad in fails.items()]))
    return docs.select(id_col, F.explode(found).alias("f")).select(id_col, "f.*")
