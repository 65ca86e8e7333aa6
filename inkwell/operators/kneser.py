"""Interpolated Kneser-Ney language models (Chen and Goodman, 1999), fitted on the corpus as joins and counts.

For order 2: p(w | v) = max(c(v w) - D, 0) / c(v) + D * n(v) / c(v) * p(w), where n(v) counts the words seen behind v, and
p(w) = max(n(w) - D, 0) / N + D * V / N * 1 / (V + 1) takes the number n(w) of words seen before w in place of its
count. N are the distinct pairs, V the distinct second words; the last term leaves a share to words never seen. Order 3
puts the same step on top. Counts are tables of n-grams; texts meet them by joins on the n-gram, a row for each
distinct n-gram of the corpus, whose counts were combined before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators.tables import stored

#: Absolute discount, and the mark before a sentence's first word.
DISCOUNT, START = 0.75, "<s>"
#: Tokens of a text that are scored; the limit of the scorer this stands for.
TOKENS = 512


def word_array(text: Column) -> Column:
    """Lower-case words and single marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{T.WORD}+|[^\p{{L}}\p{{N}}_\s]"), F.lit(0))


def grams(sentences: DataFrame, keys: list[str], order: int = 2, text_col: str = "sent") -> DataFrame:
    """``(keys, place, w, h1[, h2])``: each word with the ``order - 1`` words before it, ``START`` before the first."""
    rows = sentences.select(*keys, word_array(F.col(text_col)).alias("_ws"))

    def each(ws: Column) -> Column:
        before = lambda i, k: F.when(i >= k, F.get(ws, i - k)).otherwise(START)
        return F.transform(ws, lambda w, i: F.struct(w.alias("w"), *[before(i, k).alias(f"h{k}") for k in range(1, order)]))

    return rows.select(*keys, F.posexplode(F.get(F.transform(F.array("_ws"), each), 0)).alias("place", "g")).select(*keys, "place", "g.*")


@dataclass
class Model:
    """Written tables: ``levels[k]`` has, for each n-gram of k + 2 words, its probability given the words before it; ``words`` that of a word
    by itself; ``unseen`` that of a word never seen. ``rest[k]`` has the share that a context leaves to shorter ones."""

    order: int
    words: DataFrame
    unseen: float
    levels: list[DataFrame]
    rest: list[DataFrame]


def fit(sentences: DataFrame, order: int = 2, text_col: str = "sent", discount: float = DISCOUNT) -> Model:
    """A model of ``order`` 2 or 3 over all sentences; an empty corpus gives every word the probability 1."""
    context = [f"h{k}" for k in range(order - 1, 0, -1)]
    counts = stored(grams(sentences, [], order, text_col).groupBy(*context, "w").agg(F.count(F.lit(1)).alias("c")), "kneser-counts")
    tables = {order: counts}
    for k in range(order - 1, 1, -1):  # of shorter n-grams the number of words seen before them
        tables[k] = stored(tables[k + 1].groupBy(*context[order - k :], "w").agg(F.count(F.lit(1)).alias("c")), f"kneser-{k}")
    single = stored(tables[2].groupBy("w").agg(F.count(F.lit(1)).alias("c")), "kneser-1")
    kinds, pairs = single.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    even = 1.0 / (kinds + 1)
    share = discount * kinds / pairs if pairs else 1.0
    words = stored(single.select("w", (F.greatest(F.col("c") - discount, F.lit(0.0)) / F.lit(float(max(pairs, 1))) + share * even).alias("p")), "kneser-words")
    levels, rest, below = [], [], words
    for k in range(2, order + 1):
        own = context[order - k :]
        left = tables[k].groupBy(*own).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        left = stored(left.select(*own, "total", (discount * F.col("kinds") / F.col("total")).alias("rest")), f"kneser-rest-{k}")
        joined = tables[k].join(left, own).join(below, [*own[1:], "w"])
        p = F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("total") + F.col("rest") * F.col("p")
        below = stored(joined.select(*own, "w", p.alias("p")), f"kneser-p-{k}")
        levels.append(below)
        rest.append(left.select(*own, "rest"))
    return Model(order, words, share * even, levels, rest)


def surprisals(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``nll``, the negative log probability of each row's ``w`` behind its ``h`` columns.

    Distinct n-grams are looked up, not occurrences: rows of one n-gram are counted first by the caller or share the
    looked-up value here by one join.
    """
    context = [f"h{k}" for k in range(model.order - 1, 0, -1)]
    kinds = rows.select(*context, "w").distinct().join(model.words, "w", "left").withColumn("q", F.coalesce("p", F.lit(model.unseen))).drop("p")
    for k, (level, rest) in enumerate(zip(model.levels, model.rest), 2):
        own = context[model.order - k :]
        kinds = kinds.join(level, [*own, "w"], "left").join(rest, own, "left")
        kinds = kinds.withColumn("q", F.coalesce("p", F.coalesce("rest", F.lit(1.0)) * F.col("q"))).drop("p", "rest")
    kinds = stored(kinds.select(*context, "w", (-F.log("q")).alias("nll")), "kneser-found")
    return rows.join(kinds, [*context, "w"])


def unit_perplexity(units: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "sent", tokens: int = TOKENS) -> DataFrame:
    """``(id, pos, n, perplexity)`` of the texts ``(id, pos, sent)``: exp of the mean over their first ``tokens`` words, of 2 at least."""
    rows = grams(units, [id_col, "pos"], model.order, text_col).where(F.col("place") < tokens)
    # sums are of whole millionths, so that their order doesn't matter
    scored = surprisals(rows, model).withColumn("q", F.round(F.col("nll") * 1e6).cast("long"))
    out = scored.groupBy(id_col, "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q")).where("n >= 2")
    return out.select(id_col, "pos", "n", F.round(F.exp(F.col("q") / (F.col("n") * 1e6)), 4).alias("perplexity"))


def document_perplexity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_words: int = 4) -> DataFrame:
    """``(id, n_sentences, perplexity, spread, ai_score)`` of documents with two words or more.

    ``perplexity`` is that of the text's first words, ``spread`` the population deviation of the perplexities of its sentences of
    at least ``least_words`` words, 0 if there is at most one, ``ai_score`` the 0-to-100 score of the former. Null and shorter
    texts have no row; ids must not repeat.
    """
    from inkwell.operators.style import perplexity_score

    whole = docs.select(id_col, F.lit(-1).alias("pos"), F.col(text_col).alias("sent"))
    sents = T.sentences(docs, id_col, text_col).where(T.words(F.col("sent")) >= least_words)
    rows = unit_perplexity(whole.unionByName(sents.select(id_col, "pos", "sent")), model, id_col)
    exact = lambda c: c.cast("decimal(38,0)")
    w = F.when(F.col("pos") >= 0, F.round(F.col("perplexity") * 1e4).cast("long"))  # whole ten-thousandths
    rows = rows.withColumn("w", w).groupBy(id_col).agg(F.max(F.when(F.col("pos") < 0, F.col("perplexity"))).alias("perplexity"), F.count("w").alias("m"), F.sum("w").alias("s"), F.sum(exact(F.col("w")) * exact(F.col("w"))).alias("ss"))
    spread = F.sqrt((F.col("m") * exact(F.col("ss")) - exact(F.col("s")) * exact(F.col("s"))).cast("double")) / (F.col("m") * 1e4)
    rows = rows.where(F.col("perplexity").isNotNull())
    return rows.select(id_col, F.col("m").alias("n_sentences"), "perplexity", F.round(F.when(F.col("m") > 1, spread).otherwise(0.0), 6).alias("spread"), perplexity_score(F.col("perplexity")).alias("ai_score"))
