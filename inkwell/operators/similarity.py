"""TF-IDF in any scope, and similarity joins as term joins.

Over a corpus a vector is rows of (unit, term, weight), unit length; a dot product is an equi-join on the term and a sum
by pair. Vocabularies with a cap are broadcast, since the cap bounds them. Vectors that are fitted on one document
stay in its row, so that its texts are shuffled and its terms are not.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import text as T
from inkwell.operators import scopes
from inkwell.operators.tables import stored

#: Queries and vectors of a block of the dense search, and vectors multiplied at once.
QUERY_BLOCK, VECTOR_BLOCK, STRIP = 1024, 16384, 1024
#: Queries of a block where only the best of each are kept: every block gets all vectors by the shuffle, so these are many.
SEARCH_BLOCK = 16384
#: Rounding of products.
SLACK = 1e-6
#: Most queries whose vectors are broadcast, 16 MB of 256 doubles each.
BROADCAST_QUERIES = 8192
TECHNICAL = ["ML", "AI", "DL", "NN", "NLP", "CV", "RL"]


def term_counts(units: DataFrame, keys: list[str], text: Column, n_max: int = 1, stop: bool = True) -> DataFrame:
    """``(keys, term, tf)``."""
    return units.select(*keys, F.explode(T.grams(T.analysed(text, stop), n_max)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def vocabulary(counts: DataFrame, units: int, max_features: int, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """``(term, idf)`` of the most frequent terms, ties by term; at most ``max_features`` rows."""
    terms = counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    terms = terms.where((F.col("df") >= min_df) & (F.col("df") <= max_df * units))
    return terms.orderBy(F.desc("tf"), "term").limit(max_features).select("term", idf(F.lit(units), F.col("df")).alias("idf"))


def own_words(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``(id, _words)``, written: analysed words of all rows of an id. Words are made and shuffled once, with their document."""
    return stored(docs.groupBy(id_col).agg(F.flatten(F.collect_list(T.analysed(text))).alias("_words")), "own-words")


def word_sums(own: DataFrame) -> DataFrame:
    """``(term, tf, df)`` of rows of ``_words``, summed by batch before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_words")
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            each = pa.table({"term": lists.flatten(), "row": row}).group_by(["term", "row"]).aggregate([([], "count_all")])
            yield from each.group_by("term").aggregate([("count_all", "sum"), ([], "count_all")]).select(["term", "count_all_sum", "count_all"]).rename_columns(["term", "tf", "df"]).to_batches()

    return own.select("_words").mapInArrow(run, "term string, tf long, df long").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def most_frequent(sums: DataFrame, units: int, n: int) -> DataFrame:
    """``(term, idf)`` of the ``n`` most frequent terms of ``word_sums``, ties by term."""
    return sums.orderBy(F.desc("tf"), "term").limit(n).select("term", idf(F.lit(units), F.col("df")).alias("idf"))


def cosines(own: DataFrame, weights: dict[str, float], queries: dict, id_col: str, query_kind: str) -> DataFrame:
    """``(query_id, id, lexical)``: cosines of ``own_words`` and a few given queries, unit vectors over the ``weights`` of the terms.

    Only queries that share a term with a document have a row. A task holds the weights and a column for each query.
    """
    terms = sorted(weights)
    place = {t: i for i, t in enumerate(terms)}
    sides = np.zeros((len(terms), len(queries)))
    for j, q in enumerate(queries.values()):
        for t, w in q.items():
            sides[place[t], j] = w
    shared = own.sparkSession.sparkContext.broadcast((terms, np.array([weights[t] for t in terms]), list(queries), sides))
    kind = own.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, names, sides = shared.value
        for batch in batches:
            lists = batch.column("_words")
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=pa.array(terms, lists.type.value_type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            pairs, tf = np.unique((row * len(terms) + at)[at >= 0], return_counts=True)
            row, at = pairs // max(len(terms), 1), pairs % max(len(terms), 1)
            w = tf * idf[at]
            norm = np.sqrt(np.bincount(row, w * w, minlength=len(lists)))
            for j, name in enumerate(names):
                side = sides[at, j]
                dot, met = np.bincount(row, w * side, minlength=len(lists)), np.flatnonzero(np.bincount(row[side != 0], minlength=len(lists)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(met)), batch.column(id_col).take(pa.array(met)), pa.array(dot[met] / norm[met])], names=["query_id", id_col, "lexical"])

    return own.mapInArrow(run, f"query_id {query_kind}, {id_col} {kind}, lexical double").withColumn("lexical", F.round("lexical", 6))


def unit_length(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weights divided by their unit's norm."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return weights.withColumn("w", F.col("w") / norm)


def weigh(units: DataFrame, keys: list[str], text: Column, vocab: DataFrame, n_max: int, stop: bool = True) -> DataFrame:
    """Unit vectors over a fitted vocabulary; other terms go before anything is counted."""
    terms = units.select(*keys, F.explode(T.grams(T.analysed(text, stop), n_max)).alias("term")).join(F.broadcast(vocab), "term")
    counts = terms.groupBy(*keys, "term", "idf").agg(F.count("*").alias("tf"))
    return unit_length(counts.select(*keys, "term", "idf", (F.col("tf") * F.col("idf")).alias("w")), keys)


def gathered(docs: DataFrame, id_col: str, text_col: str, *cut: Callable[[Column], Column]) -> DataFrame:
    """``(id, _u0, _u1, ...)``: what each of ``cut`` makes of the texts of an id, arrays that are appended if the id repeats.

    The texts alone are shuffled, once; whatever is made of them stays in the row of its id.
    """
    texts = docs.groupBy(id_col).agg(F.collect_list(text_col).alias("_ts"))
    return texts.select(id_col, *[F.flatten(F.transform("_ts", c)).alias(f"_u{i}") for i, c in enumerate(cut)])


def sentence_units(text: Column) -> Column:
    """Non-empty sentences of a text: structs of ``pos`` and ``text``."""
    every = F.transform(T.sentence_array(text), lambda s, i: F.struct(i.alias("pos"), F.trim(s).alias("text")))
    return F.filter(every, lambda x: x["text"] != "")


def analysed_units(units: Column, stop: bool = True) -> Column:
    """Structs of ``pos`` and ``words``."""
    return F.transform(units, lambda x: F.struct(x["pos"].alias("pos"), T.analysed(x["text"], stop).alias("words")))


def _vectors(units: list[dict], n_max: int = 1) -> dict[int, dict[str, float]]:
    """Unit vectors by ``pos`` over one- to ``n_max``-word terms, fitted on these units alone; equal positions are one unit."""
    counts: dict[int, Counter] = {}
    for u in units:
        words, held = u["words"] or [], counts.setdefault(u["pos"], Counter())
        for n in range(1, n_max + 1):
            held.update(words if n == 1 else map(" ".join, zip(*(words[k:] for k in range(n)))))
    df = Counter(t for c in counts.values() for t in c)
    weight = {t: math.log((1 + len(units)) / (1 + d)) + 1 for t, d in df.items()}
    out = {}
    for at, c in counts.items():
        w = {t: tf * weight[t] for t, tf in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out[at] = {t: x / norm for t, x in w.items()}
    return out


def _dot(a: dict[str, float], b: dict[str, float]) -> float:
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return sum(w * b[t] for t, w in a.items() if t in b)


def in_scope(units: Column, work: Callable[[list[dict]], list], kind: pa.DataType, sql_type: str) -> Column:
    """``work`` on each row's units (``pos, words``), in Arrow batches."""
    return F.arrow_udf(lambda c: pa.array([work(u or []) for u in c.to_pylist()], kind), sql_type)(units)


def prefix(weights: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The rarest terms of each unit vector, up to the last one that the terms from it on can reach ``threshold`` with.

    Two vectors whose prefixes, by one order of terms, share none have a product below the threshold: what they
    share lies behind one prefix's end, where the vector's length is below it. So the commonest terms make no pairs.
    """
    common_first = Window.partitionBy(*keys).orderBy("idf", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # products are rounded to six places before they are compared
    reach = F.sum(F.col("w") * F.col("w")).over(common_first)
    return weights.withColumn("_reach", reach).where(F.col("_reach") >= (threshold - 1e-5) ** 2).drop("_reach")


def fit_corpus(refs: DataFrame, ref_id: str, text_col: str, max_features: int, n_max: int = 2, max_df: float = 1.0) -> DataFrame:
    counts = term_counts(refs, [ref_id], F.col(text_col), n_max)
    return vocabulary(counts, refs.count(), max_features, max_df=max_df)


def corpus_scores(docs: DataFrame, refs: DataFrame, doc_id: str = "doc_id", ref_id: str = "item_id", text_col: str = "text", max_features: int = 5000, threshold: float = 0.7) -> DataFrame:
    """For each document the largest cosine to a reference times 100, and the verdict.

    The model is fitted on the references; unknown terms are dropped. Documents without a known term
    score 0.
    """
    from inkwell.operators.ranking import best_cosines

    best = best_cosines(docs, refs, doc_id, ref_id, text_col, max_features)
    rows = best.select(F.col("id").alias(doc_id), F.round(F.col("s") * 100, 6).alias("score"))
    band = F.when(F.col("score") < 30, "low").when(F.col("score") < 60, "moderate").when(F.col("score") <= threshold * 100, "high").otherwise("very high")
    return rows.select(doc_id, "score", (F.col("score") > threshold * 100).alias("flagged"), band.alias("band"))


def clean_sentences(rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``(id, pos, proc)``: sentences of over 10 characters whose normal form has over 20."""
    # normal forms are made before the sentences become rows; a filter on them would make them twice
    proc = F.transform(T.sentence_array(F.col(text_col)), lambda s: F.when(F.length(F.trim(s)) > 10, T.normalise(F.trim(s))))
    return rows.select(id_col, F.posexplode(proc).alias("pos", "proc")).where(F.length("proc") > 20)


def sentence_pairs(docs: DataFrame, refs: DataFrame, doc_id: str = "doc_id", ref_id: str = "item_id", text_col: str = "text", max_features: int = 5000, threshold: float = 0.7, limit: int = 5) -> DataFrame:
    """Pairs of a document's and a reference's sentence with a cosine over ``threshold``, the best ``limit`` of each document.

    The model is fitted on whole references.
    """
    vocab = fit_corpus(refs, ref_id, text_col, max_features)
    a = weigh(clean_sentences(docs, doc_id, text_col), [doc_id, "pos"], F.col("proc"), vocab, 2)
    r = clean_sentences(refs, ref_id, text_col).withColumnRenamed("pos", "ref_pos")
    b = weigh(r, [ref_id, "ref_pos"], F.col("proc"), vocab, 2).withColumnRenamed("w", "v")
    rare = prefix(b.withColumnRenamed("v", "w"), [ref_id, "ref_pos"], threshold).select("term", ref_id, "ref_pos")
    near = prefix(a, [doc_id, "pos"], threshold).select("term", doc_id, "pos").join(rare, "term").select(doc_id, "pos", ref_id, "ref_pos").distinct()
    both = near.join(a.select(doc_id, "pos", "term", "w"), [doc_id, "pos"]).join(b.select(ref_id, "ref_pos", "term", "v"), [ref_id, "ref_pos", "term"])
    dots = both.groupBy(doc_id, "pos", ref_id, "ref_pos").agg(F.round(F.sum(F.col("w") * F.col("v")), 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy(doc_id).orderBy(F.desc("similarity"), "pos", ref_id, "ref_pos"))
    rows = dots.where(F.col("similarity") > threshold).withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)
    return rows.withColumns({c: F.col(c).cast("long") for c in ("pos", "ref_pos")})


def _later(a: list[int], b: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs of ascending positions, the second at least two behind the first, in order."""
    for i in a:
        at = bisect_right(b, i + 1)
        if at == len(b):
            return
        for k in range(at, len(b)):
            yield i, b[k]


def _repeats(threshold: float, limit: int):
    """The first ``limit`` pairs ``(similarity, i, j)`` of a document's units, the most similar first.

    Units of one vector are one class: a pair of classes has one product and gives its pairs in order, so that only those that may be
    among the first are made. Classes meet in the rarest terms of their vectors (see ``prefix``).
    """

    def work(units: list[dict]) -> list[dict]:
        vectors, members = _vectors(units), defaultdict(list)
        for i in sorted(vectors):
            if vectors[i]:
                members[tuple(sorted(vectors[i].items()))].append(i)
        places, df = list(members.values()), Counter(t for key in members for t, _ in key)
        seen, best = defaultdict(list), []
        for k, key in enumerate(members):
            v, left, near = vectors[places[k][0]], 1.0, {k}
            for t, w in sorted(key, key=lambda x: (df[x[0]], x[0])):
                # what is left from here on can't reach the threshold any more
                if left < (threshold - 1e-5) ** 2:
                    break
                left -= w * w
                near.update(seen[t])
                seen[t].append(k)
            for m in near:
                s = math.floor(_dot(v, vectors[places[m][0]]) * 1e6 + 0.5) / 1e6
                if s < threshold:
                    continue
                a, b = places[k], places[m]
                pairs = _later(a, a) if m == k else heapq.merge(_later(a, b), _later(b, a))
                best += [(-s, i, j) for i, j in islice(pairs, limit)]
            best = heapq.nsmallest(limit, best)
        return [{"similarity": -s, "i": i, "j": j} for s, i, j in best]

    return work


def repeated_sentences(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", threshold: float = 0.8, min_words: int = 8, limit: int = 25) -> DataFrame:
    """Pairs of sentences of one document, not adjoining, with a cosine of at least ``threshold``.

    The model is fitted on each document's sentences of at least ``min_words`` words; places count
    those sentences.
    """
    long = lambda t: F.filter(sentence_units(t), lambda x: T.words(x["text"]) >= min_words)
    rows = gathered(docs, doc_id, text_col, long)
    placed = F.transform(F.array_sort("_u0"), lambda x, i: F.struct(i.alias("pos"), x["text"].alias("text")))
    kind = pa.list_(pa.struct([("similarity", pa.float64()), ("i", pa.int64()), ("j", pa.int64())]))
    found = in_scope(analysed_units(placed), _repeats(threshold, limit), kind, "array<struct<similarity:double,i:long,j:long>>")
    rows = rows.select(doc_id, F.posexplode(found).alias("_r", "p"))
    return rows.select(doc_id, "p.i", "p.j", "p.similarity", (F.col("_r") + 1).cast("long").alias("rank"))


def cohesion(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", floor: float = 0.05) -> DataFrame:
    """``(id, pos, similarity, threshold, linked, weak)``: similarity of each paragraph to the next, and whether the transition is weak."""
    columns = "pos long, similarity double, threshold double, linked boolean, weak boolean"
    return scopes.by_rows(docs, doc_id, text_col, scopes.transitions(floor), columns)


def summary_sentences(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """The ``n`` sentences of largest TF-IDF sum in document order; a document of no more has all of them."""
    rows = gathered(docs, doc_id, text_col, sentence_units)
    sums = in_scope(analysed_units(F.col("_u0"), stop=False), _lengths, pa.list_(pa.float64()), "array<double>")
    # the best first: by the negative score, then by place
    every = F.transform(F.arrays_zip(F.col("_u0").alias("u"), F.col("s").alias("s")), lambda z: F.struct((-F.round(z["s"], 6)).alias("below"), z["u"]["pos"].alias("pos")))
    best = F.slice(F.array_sort(every), 1, n)
    in_order = F.array_sort(F.transform(best, lambda x: F.struct(x["pos"].alias("pos"), F.abs(x["below"]).alias("score"))))
    rows = rows.withColumn("s", sums).select(doc_id, F.posexplode(in_order).alias("place", "x"))
    return rows.select(doc_id, F.col("x.pos").cast("long").alias("pos"), "x.score", (F.col("place") + 1).cast("long").alias("place"))


def _lengths(units: list[dict]) -> list[float]:
    """The sum of each unit's weights."""
    v = _vectors(units)
    return [sum(v[u["pos"]].values(), 0.0) for u in units]


def keyword_scores(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, term, score, rank)``: all one- and two-word terms by their TF-IDF sum over sentences."""
    return scopes.by_rows(docs, doc_id, text_col, scopes.scored_terms, "term string, score double, rank long")


def keywords(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", top: int = 8) -> DataFrame:
    """The best terms of each document, less those whose words all stand in a chosen one, chosen among all its terms."""
    return scopes.by_rows(docs, doc_id, text_col, scopes.chosen_terms(top), "place long, term string")


def complexity(text: Column) -> Column:
    """0.3 words per sentence + 0.4 share of distinct words + 0.3 share of ``TECHNICAL`` words, at most 1; 0 without words."""
    sents = F.size(F.filter(T.sentence_array(text), lambda s: F.trim(s) != ""))

    def share(tokens: Column) -> Column:
        n, technical = F.size(tokens), F.size(F.filter(tokens, lambda w: w.isin(TECHNICAL)))
        return F.when(n > 0, F.least(0.3 * n / sents + 0.4 * F.size(F.array_distinct(tokens)) / n + 0.3 * technical / n, F.lit(1.0))).otherwise(0.0)

    # bound to a variable, so that the tokens are cut once and not for each use
    return F.get(F.transform(F.array(T.tokens(text)), share), 0)


def _sides(units: list[dict]) -> float:
    v = _vectors(units, 2)
    return _dot(v.get(0, {}), v.get(1, {}))


def pair_similarity(pairs: DataFrame, pair_id: str, left: str, right: str) -> DataFrame:
    """0.5 cosine + 0.3 structure + 0.2 Jaccard of each pair of texts, its adaptive threshold and category.

    The cosine's model (one- and two-word terms) is fitted on the pair. Structure is the share of
    sentence positions, up to the shorter text's end, whose word counts differ by under 0.3 of the larger.
    The threshold is 0.6 for a left text of under 100 words, else 0.75 if its complexity is over 0.8, else 0.7.
    """
    both = lambda p: F.array(F.struct(F.lit(0).alias("pos"), p[left].alias("text")), F.struct(F.lit(1).alias("pos"), p[right].alias("text")))
    held = pairs.groupBy(pair_id).agg(F.collect_list(F.struct(left, right)).alias("_ps"))
    cosine = in_scope(analysed_units(F.flatten(F.transform("_ps", both))), _sides, pa.float64(), "double")
    pairs = held.select(pair_id, "_ps", cosine.alias("cosine")).select(pair_id, "cosine", F.inline("_ps"))
    lens = lambda c: F.transform(F.filter(T.sentence_array(F.col(c)), lambda s: F.trim(s) != ""), T.words)
    n = F.least(F.size(lens(left)), F.size(lens(right)))
    near = F.size(F.filter(F.zip_with(F.slice(lens(left), 1, n), F.slice(lens(right), 1, n), lambda a, b: F.abs(a - b) / F.greatest(a, b, F.lit(1)) < 0.3), lambda x: x))
    a, b = F.array_distinct(T.analysed(F.col(left))), F.array_distinct(T.analysed(F.col(right)))
    union = F.size(F.array_union(a, b))
    rows = pairs.select(pair_id, "cosine", F.when(n > 0, near / n).otherwise(0.0).alias("structure"), F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0).alias("jaccard"), T.words(F.col(left)).alias("n"), complexity(F.col(left)).alias("complexity"))
    rows = rows.withColumn("score", F.round(F.least(0.5 * F.col("cosine") + 0.3 * F.col("structure") + 0.2 * F.col("jaccard"), F.lit(1.0)), 6))
    rows = rows.withColumn("threshold", F.least(F.greatest(F.when(F.col("n") < 100, 0.6).when(F.col("complexity") > 0.8, 0.75).otherwise(0.7), F.lit(0.5)), F.lit(0.9)))
    s, t = F.col("score"), F.col("threshold")
    category = F.when(s >= F.round(t + 0.1, 6), "high").when(s >= t, "medium").when(s >= F.round(t - 0.2, 6), "low").otherwise("none")
    return rows.select(pair_id, F.round("cosine", 6).alias("cosine"), F.round("structure", 6).alias("structure"), F.round("jaccard", 6).alias("jaccard"), "score", "threshold", category.alias("category"), F.round(F.least(1.2 * s, F.lit(0.95)), 6).alias("confidence"))


def dense_scores(queries: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Dot products of all vectors with each other vector of a given set of queries.

    Queries are packed into blocks of about ``QUERY_BLOCK``, and each vector meets each block by an equi-join. Blocks are broadcast
    if there are at most ``BROADCAST_QUERIES`` queries. Null vectors have a null product; repeated rows stay.
    """
    n = queries.count()
    blocks = max(1, math.ceil(n / QUERY_BLOCK))
    packed = queries.select(F.struct(F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("q")).alias("_q"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("_block"))
    packed = packed.groupBy("_block").agg(F.collect_list("_q").alias("_qs"))
    packed = F.broadcast(packed) if n <= BROADCAST_QUERIES else packed
    rows = vectors.select(id_col, F.col(vector_col).cast("array<double>").alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")).join(packed, "_block")
    rows = rows.select(id_col, "_v", F.explode("_qs").alias("_q")).where(F.col("_q.query_id") != F.col(id_col))
    dot = F.aggregate(F.zip_with("_q.q", "_v", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("_q.query_id", id_col, F.round(dot, 6).alias("similarity"))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` vectors of largest dot product for each query, ties by id.

    Both sides are dealt by hash into blocks of about ``SEARCH_BLOCK`` queries and ``VECTOR_BLOCK`` vectors. A
    task holds one block of each and a running top ``k`` of every query, so it returns ``k`` rows a query
    and block of vectors instead of the products. Null vectors and those of another length have no product.
    """
    blocks, chunks = (max(1, math.ceil(rows.count() / size)) for rows, size in ((queries, SEARCH_BLOCK), (vectors, VECTOR_BLOCK)))
    dealt = lambda rows, name, n: rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"), F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias(name))
    with_each = lambda rows, name, n: rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    q = with_each(dealt(queries, "block", blocks), "chunk", chunks).groupBy("block", "chunk")
    v = with_each(dealt(vectors, "chunk", chunks), "block", blocks).groupBy("block", "chunk")
    kind = vectors.schema[id_col].dataType.simpleString()
    best = q.cogroup(v).applyInArrow(_best_of_block(k, id_col), f"query_id {kind}, {id_col} {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids, ascending, and matrix of the vectors of each length."""
    table = table.sort_by("id").combine_chunks()
    ids, sizes = table.column("id").to_numpy(), pc.list_value_length(table.column("x")).to_numpy()
    values = lambda rows: pa.concat_arrays([c.flatten() for c in rows.chunks]) if rows.num_chunks else pa.array([], pa.float64())
    return {int(n): (ids[sizes == n], values(table.column("x").filter(pa.array(sizes == n))).to_numpy(zero_copy_only=False).reshape(-1, int(n))) for n in np.unique(sizes)}


def _best_of_strips(k: int, q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, item and product of the first ``k`` of each query.

    Items come by id, so that a later one counts only if its rounded product is above the ``k``-th that a query has; only what may be is rounded and sorted.
    """
    row, item, sim = np.zeros(0, np.int64), np.zeros(0, v_ids.dtype), np.zeros(0)
    least = np.full(len(q), -np.inf)
    for at in range(0, len(v_ids), STRIP):
        ids, s = v_ids[at : at + STRIP], q @ v[at : at + STRIP].T
        bound = least - SLACK
        if np.isinf(bound).any() and len(ids) > k:
            others = np.where(np.isnan(s) | (q_ids[:, None] == ids[None, :]), -np.inf, s)
            bound = np.maximum(bound, np.partition(others, len(ids) - k, axis=1)[:, len(ids) - k] - SLACK)
        r, c = np.nonzero(s >= bound[:, None])
        got = np.round(s[r, c], 6) + 0.0
        kept = (got > least[r]) & (q_ids[r] != ids[c])
        if not kept.any():
            continue
        row, item, sim = np.concatenate([row, r[kept]]), np.concatenate([item, ids[c[kept]]]), np.concatenate([sim, got[kept]])
        order = np.lexsort((item, -sim, row))
        row, item, sim = row[order], item[order], sim[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, item, sim, place = row[place < k], item[place < k], sim[place < k], place[place < k]
        least[row[place == k - 1]] = sim[place == k - 1]
    return row, item, sim


def _best_of_block(k: int, id_col: str):
    def work(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found, vs = [], _by_length(vectors)
        for n, (q_ids, q) in _by_length(queries).items():
            v_ids, v = vs.get(n, (q_ids[:0], q[:0]))
            for at in range(0, len(q), STRIP):
                own = q_ids[at : at + STRIP]
                row, item, sim = _best_of_strips(k, own, q[at : at + STRIP], v_ids, v)
                found.append((own[row], item, sim))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", id_col, "similarity"), columns)))

    return work


def fuse(lexical: DataFrame, dense: DataFrame, keys: list[str], item: str, k: int = 4, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two scorings of the same items, ranks from 0, ties by item.

    The k best of one list score at least 1 / (constant + k - 1), so an item that is in both lists behind
    place constant + 2 * (k - 1) can't be among the k best of the fusion. Only the items before that place
    in a list, a bounded number, are ranked, each by counting the items ahead of it: no list is sorted
    in one task.
    """
    rows = lexical.join(dense, [*keys, item], "full").fillna(0.0, ["lexical", "dense"])
    reach = constant + 2 * (k - 1) + 1
    first = lambda c: rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(c), item))).where(F.col("_r") <= reach).drop("_r")
    near = first("lexical").unionByName(first("dense")).distinct().select(*keys, F.col(item).alias("_i"), F.col("lexical").alias("_l"), F.col("dense").alias("_d"))
    ahead = lambda c, own: F.count_if((F.col(c) > F.col(own)) | ((F.col(c) == F.col(own)) & (F.col(item) < F.col("_i"))))
    ranks = rows.join(F.broadcast(near), keys).groupBy(*keys, "_i", "_d").agg(ahead("lexical", "_l").alias("lexical_rank"), ahead("dense", "_d").alias("dense_rank"))
    rows = ranks.withColumn("fused", F.round(1.0 / (constant + F.col("lexical_rank")) + 1.0 / (constant + F.col("dense_rank")), 9))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("fused"), "_i"))
    return rows.withColumn("rank", order.cast("long")).where(F.col("rank") <= k).select(*keys, F.col("_i").alias(item), F.round(F.greatest("_d", F.lit(0.0)), 6).alias("score"), "fused", "rank")


def rerank(items: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Items with a ``similarity`` in order of it; without one they keep their ``place``."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("similarity"), "place", item))
    return items.withColumn("rank", order.cast("long"))


def keep_first(rows: DataFrame, key: Column, order: str, partition: list[str] | None = None) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*(partition or []), key).orderBy(order))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def corpus_statistics(refs: DataFrame, ref_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Documents and comparable sentences of a reference corpus."""
    s = clean_sentences(refs, ref_id, text_col).groupBy(ref_id).agg(F.count("*").alias("n"))
    return refs.select(ref_id).join(s, ref_id, "left").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("sentences"))
