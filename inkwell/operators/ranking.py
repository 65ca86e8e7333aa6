"""Every document against every reference, without a join on terms.

References are the small side. They are packed in blocks of at most ``BLOCK`` into matrices of a known size and
broadcast block by block; documents stay where they lie and each one meets a whole block in one matrix
product. So a term that all documents share makes no rows, and no key is hot. References of any number run, a
pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import similarity as S

#: References of a block, and documents that meet it at once. A block is ``BLOCK`` x vocabulary doubles, 20 MB for 5000 terms.
BLOCK, STRIP = 512, 64
#: Rounding of scores and of the thresholds they are held against.
SLACK = 1e-6


class Packed:
    """A block of references: unit vectors over the vocabulary, word sets and words of each sentence."""

    def __init__(self, ids: list, words: list[list[str]], lens: list[list[int]], vocab: dict[str, int], idf: np.ndarray):
        self.ids, self.vocab, self.idf = ids, vocab, idf
        self.matrix = unit_rows(words, vocab, idf).T.copy()
        self.known = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.sets, self.sizes = member_rows(words, self.known).T.copy(), np.array([len(set(ws)) for ws in words])
        self.counts = np.array([len(x) for x in lens])
        self.lens = np.zeros((len(lens), max(1, self.counts.max(initial=0))))
        for row, x in zip(self.lens, lens):
            row[: len(x)] = x

    def structure(self, lens: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Share of sentence places, up to the shorter text's end, whose word counts differ by under 0.3 of the larger."""
        n = np.minimum(len(lens), self.counts[rows])
        width = int(n.max(initial=0))
        a, b = lens[None, :width], self.lens[rows, :width]
        near = np.abs(a - b) / np.maximum(np.maximum(a, b), 1) < 0.3
        hits = (near & (np.arange(width)[None, :] < n[:, None])).sum(axis=1)
        return np.where(n > 0, hits / np.maximum(n, 1), 0.0)


def grams(ws: list[str]) -> Iterator[str]:
    yield from ws
    yield from map(" ".join, zip(ws, ws[1:]))


def unit_rows(words: list[list[str]], vocab: dict[str, int], idf: np.ndarray) -> np.ndarray:
    """Dense TF-IDF rows of unit length; a text without a known term has zeros."""
    out = np.zeros((len(words), len(idf)))
    for row, ws in zip(out, words):
        at = [i for i in map(vocab.get, grams(ws)) if i is not None]
        if at:
            row += np.bincount(at, minlength=len(idf))
    out *= idf
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1.0)


def member_rows(words: list[list[str]], known: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(words), len(known)), np.float32)
    for row, ws in zip(out, words):
        row[[i for i in map(known.get, set(ws)) if i is not None]] = 1
    return out


def sentence_words(text: Column) -> Column:
    return F.transform(F.filter(T.sentence_array(text), lambda s: F.trim(s) != ""), T.words)


def packed_blocks(refs: DataFrame, ref_id: str, text_col: str, max_features: int) -> Iterator[Packed]:
    """The references in order of their ids, a block at a time; one block and the capped vocabulary are at the driver."""
    vocab = S.fit_corpus(refs, ref_id, text_col, max_features).collect()  # at most max_features rows
    index, idf = {r.term: i for i, r in enumerate(vocab)}, np.array([r.idf for r in vocab])
    text = F.col(text_col)
    rows = refs.select(F.col(ref_id).alias("id"), F.coalesce(T.analysed(text), F.array()).alias("words"), F.coalesce(sentence_words(text), F.array()).alias("lens"))
    n = refs.count()
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // (BLOCK * 3 // 4))))))
    for number, size in sorted(map(tuple, numbered.groupBy("block").count().collect())):
        own = numbered.where(F.col("block") == number).orderBy("id")
        for at in range(0, size, BLOCK):
            part = own.offset(at).limit(BLOCK).collect()
            yield Packed([r.id for r in part], [r.words for r in part], [r.lens for r in part], index, idf)


def _over_documents(docs: DataFrame, doc_id: str, text_col: str, extra: dict[str, Column], packed: Packed, work, schema: str) -> DataFrame:
    """Calls ``work(packed, words, cosines, other columns)`` for strips of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    text = F.col(text_col)
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(T.analysed(text), F.array()).alias("words"), *[c.alias(n) for n, c in extra.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for at in range(0, len(batch), STRIP):
                part = batch.slice(at, STRIP)
                words = part.column("words").to_pylist()
                yield work(block, part, words, unit_rows(words, block.vocab, block.idf) @ block.matrix)

    return rows.mapInArrow(run, schema)


def best_cosines(docs: DataFrame, refs: DataFrame, doc_id: str, ref_id: str, text_col: str, max_features: int) -> DataFrame:
    """``(id, s)``: the largest cosine of each document to a reference, 0 if they share no known term."""
    kind, out, blocks = docs.schema[doc_id].dataType.simpleString(), None, 0

    def work(block: Packed, part: pa.RecordBatch, words: list, cosines: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(cosines.max(axis=1, initial=0.0))], names=["id", "s"])

    for packed in packed_blocks(refs, ref_id, text_col, max_features):
        found = _over_documents(docs, doc_id, text_col, {}, packed, work, f"id {kind}, s double")
        out, blocks = found if out is None else out.unionByName(found), blocks + 1
    if out is None:
        return docs.select(F.col(doc_id).alias("id"), F.lit(0.0).alias("s"))
    return out if blocks == 1 else out.groupBy("id").agg(F.max("s").alias("s"))


def ranked_references(docs: DataFrame, refs: DataFrame, doc_id: str = "doc_id", ref_id: str = "item_id", text_col: str = "text", max_features: int = 5000, base: float = 0.7, top: int = 5) -> DataFrame:
    """``(id, threshold, maximum, category, confidence, scored, rank, <ref_id>, score)``: a document's best references.

    The score of a pair is 0.5 cosine (one- and two-word terms, fitted on the references) + 0.3 structure + 0.2 Jaccard of the
    word sets, at most 1. The threshold is ``base`` less 0.1 for a text of under 100 words, else plus 0.05 if its complexity is
    over 0.8, kept between 0.5 and 0.9. References over the threshold less 0.3 are listed, the first ``top`` by score, then
    id; a document without any has one row with null ``rank``. ``maximum``, ``category`` and ``confidence`` regard all references.

    Cosine and Jaccard are known for a whole block at once. Structure is at most 1, so a pair's score is at most 0.3 more than
    what is known; pairs are taken in the order of this bound and the rest goes as soon as it can reach neither the
    list nor the maximum. ``scored`` counts the pairs whose structure was compared. Null and empty texts score 0; ids
    must not repeat. Without references the result has a row of nulls and 0 for each document.
    """
    kind, ref_kind = docs.schema[doc_id].dataType.simpleString(), refs.schema[ref_id].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    threshold = F.when(T.words(text) < 100, base - 0.1).when(S.complexity(text) > 0.8, base + 0.05).otherwise(base)
    extra = {"lens": sentence_words(text), "threshold": F.least(F.greatest(F.round(threshold, 6), F.lit(0.5)), F.lit(0.9))}

    def work(block: Packed, part: pa.RecordBatch, words: list, cosines: np.ndarray) -> pa.RecordBatch:
        lens, least = part.column("lens").to_pylist(), part.column("threshold").to_numpy() - 0.3
        shared, size = member_rows(words, block.known) @ block.sets, np.array([len(set(w)) for w in words])
        union = size[:, None] + block.sizes[None, :] - shared
        jaccard = shared / np.maximum(union, 1)
        best, scored, refs, scores = [], [], [], []
        for k in range(len(words)):
            own = np.array(lens[k], np.float64)
            known = 0.5 * cosines[k], 0.2 * jaccard[k].astype(np.float64)
            bound = known[0] + 0.3 + known[1]
            order = np.argsort(-bound, kind="stable")
            got, at, most = np.full(len(order), -1.0), 0, 0.0
            while at < len(order):
                need = min(max(most, SLACK), max(least[k], np.sort(got)[-top] if len(got) >= top else least[k]))
                if bound[order[at]] < need - SLACK:
                    break
                rows = order[at : at + 32]
                got[rows] = np.minimum(known[0][rows] + 0.3 * block.structure(own, rows) + known[1][rows], 1.0)
                most, at = max(most, float(got[rows].max())), at + len(rows)
            hit = np.flatnonzero(got > least[k] - SLACK)
            if len(hit) > top:
                hit = hit[got[hit] >= np.sort(got[hit])[-top] - SLACK]  # ties after rounding are settled by id
            best.append(most)
            scored.append(min(at, len(order)))
            refs.append([block.ids[i] for i in hit])
            scores.append(got[hit].tolist())
        found = [[{"ref": r, "score": s} for r, s in zip(*x)] for x in zip(refs, scores)]
        return pa.RecordBatch.from_arrays([part.column("id"), part.column("threshold"), pa.array(best), pa.array(scored, pa.int64()), pa.array(found, pa.list_(pa.struct([("ref", ref_type), ("score", pa.float64())])))], names=["id", "threshold", "best", "scored", "found"])

    from pyspark.sql.pandas.types import to_arrow_type

    ref_type, rows = to_arrow_type(refs.schema[ref_id].dataType), None
    schema = f"id {kind}, threshold double, best double, scored long, found array<struct<ref: {ref_kind}, score: double>>"
    for packed in packed_blocks(refs, ref_id, text_col, max_features):
        found = _over_documents(docs, doc_id, text_col, extra, packed, work, schema)
        rows = found if rows is None else rows.unionByName(found)
    if rows is None:
        rows = docs.select(F.col(doc_id).alias("id"), extra["threshold"].alias("threshold"), F.lit(0.0).alias("best"), F.lit(0).cast("long").alias("scored"), F.array().cast(f"array<struct<ref: {ref_kind}, score: double>>").alias("found"))
    rows = rows.groupBy("id", "threshold").agg(F.round(F.max("best"), 6).alias("maximum"), F.sum("scored").alias("scored"), F.flatten(F.collect_list("found")).alias("found"))
    m, t = F.col("maximum"), F.col("threshold")
    category = F.when(m >= F.round(t + 0.1, 6), "high").when(m >= t, "medium").when(m >= F.round(t - 0.2, 6), "low").otherwise("none")
    # at most a few more than top entries of each block
    listed = F.transform("found", lambda x: F.struct((-F.round(x["score"], 6)).alias("s"), x["ref"].alias("ref")))
    listed = F.slice(F.array_sort(F.filter(listed, lambda x: -x["s"] > F.round(t - 0.3, 6))), 1, top)
    rows = rows.select("id", "threshold", "maximum", category.alias("category"), F.round(F.least(1.2 * m, F.lit(0.95)), 6).alias("confidence"), "scored", F.posexplode_outer(listed).alias("at", "x"))
    return rows.select(F.col("id").alias(doc_id), "threshold", "maximum", "category", "confidence", "scored", (F.col("at") + 1).cast("long").alias("rank"), F.col("x.ref").alias(ref_id), (-F.col("x.s")).alias("score"))
