"""Base forms of nouns: suffix rules, checked against a lexicon that the corpus itself gives.

A rule's result counts only if the corpus writes it often enough as a word of its own, so an unknown word keeps its form. Only
words with another base form make up the fitted table; the most frequent of them are broadcast and the rest, none of which
can be frequent, are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.tables import BROADCAST_ROWS, stored

#: Suffixes of plural nouns and what stands in their place in the singular.
SUFFIXES = [("ies", "y"), ("ves", "f"), ("ves", "fe"), ("men", "man"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("ses", "s"), ("s", "")]
#: Words in a plain s that aren't plurals.
SINGULAR_ENDS = "(ss|us|is)$"
#: Irregular plurals; they need no evidence.
IRREGULAR = {
    "analyses": "analysis", "bases": "basis", "children": "child", "crises": "crisis", "criteria": "criterion", "feet": "foot", "geese": "goose", "hypotheses": "hypothesis",
    "indices": "index", "matrices": "matrix", "mice": "mouse", "oxen": "ox", "phenomena": "phenomenon", "syntheses": "synthesis", "teeth": "tooth", "theses": "thesis", "vertices": "vertex",
}
#: Occurrences that make a word an entry of the lexicon.
LEAST = 2


def stems(w: Column) -> Column:
    """What the rules make of a word, at least two characters long, in the rules' order."""
    made = [F.when(w.endswith(a) & (F.length(w) - len(a) + len(b) >= 2) & (F.lit(a != "s") | ~w.rlike(SINGULAR_ENDS)), F.concat(w.substr(F.lit(1), F.length(w) - len(a)), F.lit(b))) for a, b in SUFFIXES]
    return F.array_distinct(F.array_compact(F.array(*made)))


def fit(words: DataFrame, word_col: str = "word", least: int = LEAST) -> DataFrame:
    """``(word, lemma, n)`` of the words with another base form, from one row for each occurrence; written once.

    Of several bases in the lexicon the shortest is taken, then the first by code points. Null words count for nothing; an
    empty corpus gives an empty table.
    """
    counts = stored(words.where(F.col(word_col).isNotNull()).groupBy(F.col(word_col).alias("word")).agg(F.count("*").alias("n")), "lexicon")
    table = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    irregular = F.try_element_at(table, F.col("word"))
    fixed = counts.where(irregular.isNotNull()).select("word", irregular.alias("lemma"), "n")
    tried = counts.where(irregular.isNull()).select("word", "n", F.explode(stems(F.col("word"))).alias("lemma"))
    known = counts.where(F.col("n") >= least).select(F.col("word").alias("lemma"))
    ruled = tried.join(known, "lemma").groupBy("word", "n").agg(F.min(F.struct(F.length("lemma").alias("size"), "lemma"))["lemma"].alias("lemma"))
    return stored(fixed.unionByName(ruled), "lemmas")


def with_lemmas(rows: DataFrame, lemmas: DataFrame, word_col: str = "word", frequent: int = BROADCAST_ROWS) -> DataFrame:
    """Adds ``lemma`` to rows of words: the base form, or the word itself.

    The ``frequent`` most frequent plurals go by broadcast. What is not among them has a small share of the rows each, so that a
    shuffle of it knows no hot key; that join is left out if there is nothing for it.
    """
    if lemmas.count() <= frequent:
        top, rest = lemmas, None
    else:
        top = stored(lemmas.orderBy(F.desc("n"), "word").limit(frequent), "frequent")
        rest = lemmas.join(F.broadcast(top.select("word")), "word", "left_anti")
    named = lambda t, as_: t.select(F.col("word").alias("_w"), F.col("lemma").alias(as_))
    got = rows.join(F.broadcast(named(top, "_lemma")), F.col(word_col) == F.col("_w"), "left").drop("_w")
    if rest is None:
        return got.withColumn("lemma", F.coalesce("_lemma", word_col)).drop("_lemma")
    # only rows that may still have a base form are shuffled
    key = F.when(F.col("_lemma").isNull() & ((F.size(stems(F.col(word_col))) > 0) | F.col(word_col).isin(*IRREGULAR)), F.col(word_col))
    open_ = got.withColumn("_k", key)
    late = open_.where("_k IS NOT NULL").join(named(rest, "_late"), F.col("_k") == F.col("_w"), "left").drop("_w")
    done = open_.where("_k IS NULL").withColumn("_late", F.lit(None).cast("string"))
    return late.unionByName(done).withColumn("lemma", F.coalesce("_lemma", "_late", word_col)).drop("_lemma", "_late", "_k")


def may_change(w: Column) -> Column:
    """Whether a word ends like a plural or is an irregular one; no other word can be in a fitted table."""
    return w.rlike(f"({'|'.join(sorted({a for a, _ in SUFFIXES}))})$") | w.isin(*IRREGULAR)


def gathered(docs: DataFrame, words: Column, id_col: str = "doc_id") -> DataFrame:
    """``(id, _ws)``, written: an array of each row's words, of all rows of an id. Words are made and shuffled once, with their document."""
    return stored(docs.groupBy(id_col).agg(F.collect_list(words).alias("_ws")), "words")


def _put(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = [], []
            for rows, known in zip(batch.column("_ws").to_pylist(), batch.column("_known").to_pylist()):
                base = {k["word"]: k["lemma"] for k in known or ()}
                if len(rows) > 1:  # places of an id's rows are merged
                    pairs = [(w, lemma) for _, lemma, w in sorted((at, base.get(w, w), w) for row in rows for at, w in enumerate(row))]
                else:
                    pairs = [(w, base.get(w, w)) for row in rows for w in row]
                texts.append(" ".join(x for _, x in pairs))
                changed.append(sum(w != x for w, x in pairs))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string()), pa.array(changed, pa.int64())], names=[id_col, "lemmas", "n_changed"])

    return run


def in_texts(own: DataFrame, lemmas: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, lemmas, n_changed)`` of ``gathered`` words: base forms in the words' order, joined by spaces, and how many differ.

    Only the distinct words of a document that end like plurals leave its row, to meet the table.
    """
    each = own.select(id_col, F.explode(F.array_distinct(F.filter(F.flatten("_ws"), may_change))).alias("word"))
    found = with_lemmas(each, lemmas).where("lemma <> word").groupBy(id_col).agg(F.collect_list(F.struct("word", "lemma")).alias("_known"))
    rows = own.join(found.withColumnRenamed(id_col, "_id"), F.col(id_col).eqNullSafe(F.col("_id")), "left").select(id_col, "_ws", "_known")
    return rows.mapInArrow(_put(id_col), f"{id_col} {own.schema[id_col].dataType.simpleString()}, lemmas string, n_changed long")


def lemmatised(docs: DataFrame, words: Column, lemmas: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, lemmas)``: a document's words by base form, joined by spaces; no words give an empty text.

    Rows that repeat an id are taken as one document.
    """
    return in_texts(gathered(docs, words, id_col), lemmas, id_col).select(id_col, "lemmas")
