"""An offline embedder: a truncated singular value decomposition of the corpus's TF-IDF rows.

The decomposition is randomised (Halko, Martinsson and Tropp, 2011). With Q an orthonormal basis of as many columns
as wanted, and some more, each pass computes A' A Q: a task multiplies its own rows and returns one matrix of
vocabulary x columns, whatever the number of its rows; these are summed by term. The vocabulary has a cap, so all that
reaches the driver is of a known size. The last pass also gives Q' A' A Q, whose eigenvectors turn Q into the right
singular vectors. A text's embedding is its TF-IDF row times these, of unit length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.lexicons import STOP_WORDS
from inkwell.functions import text as T
from inkwell.operators import similarity as S
from inkwell.operators.tables import stored

#: Words of the vocabulary, values of an embedding, columns beyond these, passes that sharpen the basis.
VOCABULARY, VALUES, MORE, PASSES = 4096, 64, 16, 3
STRIP = 512
_STOP = frozenset(STOP_WORDS)
_WORD = regex.compile(r"[\p{L}\p{N}_]{2,}")


def words_of(text: str | None) -> list[str]:
    return [w for w in _WORD.findall((text or "").lower()) if w not in _STOP]


class SvdEmbedder:
    """Embeds texts by fitted term vectors; a provider for ``providers.embed`` that needs no network.

    Texts without a known word have the zero vector, which is like nothing.
    """

    def __init__(self, terms: list[str], idf: np.ndarray, vectors: np.ndarray, values: np.ndarray, total: float):
        self.terms, self.idf, self.vectors, self.values, self.total = terms, idf, vectors, values, total
        self._index: dict[str, int] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}

    def places(self, text: str | None) -> list[int]:
        """Places in the vocabulary of a text's known words."""
        if self._index is None:
            self._index = {t: i for i, t in enumerate(self.terms)}
        return [i for i in map(self._index.get, words_of(text)) if i is not None]

    def placed_rows(self, places: list[np.ndarray | list[int]]) -> np.ndarray:
        """Dense TF-IDF rows of unit length."""
        n, sizes = len(self.terms), [len(p) for p in places]
        flat = np.concatenate([np.asarray(p, np.int64) for p in places]) if places else np.zeros(0, np.int64)
        out = np.bincount(np.repeat(np.arange(len(places)) * n, sizes) + flat, minlength=len(places) * n).reshape(len(places), n)
        return _unit(out * self.idf)

    def rows(self, texts: list[str | None]) -> np.ndarray:
        return self.placed_rows([self.places(t) for t in texts])

    def embed(self, texts: list[str | None]) -> list[list[float]]:
        return [row.tolist() for at in range(0, len(texts), STRIP) for row in _unit(self.rows(texts[at : at + STRIP]) @ self.vectors)]

    def explained(self) -> float:
        """Share of the squared length of all rows that lies in the fitted vectors' span."""
        return float((self.values**2).sum() / self.total) if self.total else 0.0


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 1e-12, norm, 1.0)


def _placed(texts: DataFrame, model: SvdEmbedder) -> DataFrame:
    """``at``, written: the places of each text's known words, so that a pass over them splits no text."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.places(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))], names=["at"])

    return stored(texts.select("text").mapInArrow(run, "at array<int>"), "embedder-places")


def _product(rows: DataFrame, model: SvdEmbedder, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """A' A Q over all rows of ``_placed``, and the squared length of A."""
    n, k = basis.shape
    shared = rows.sparkSession.sparkContext.broadcast((model, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, basis = shared.value
        out, square = np.zeros((n, k)), 0.0
        for batch in batches:
            lists = batch.column(0)
            for at in range(0, len(lists), STRIP):
                a = model.placed_rows([x.values.to_numpy() for x in lists.slice(at, STRIP)])
                out += a.T @ (a @ basis)
                square += float((a * a).sum())
        used = np.flatnonzero(out.any(axis=1))
        columns = {"term": pa.array([*used.tolist(), -1], pa.int32())}
        for c in range(k):
            columns[f"y{c}"] = pa.array([*out[used, c].tolist(), square if c == 0 else 0.0])
        yield pa.RecordBatch.from_pydict(columns)

    names = [f"y{c}" for c in range(k)]
    sums = rows.mapInArrow(run, "term int, " + ", ".join(f"{c} double" for c in names)).groupBy("term").agg(*[F.sum(c).alias(c) for c in names])
    out, square = np.zeros((n, k)), 0.0
    for r in sums.collect():  # a row for each word of the vocabulary at most, and one
        if r[0] < 0:
            square = r[1]
        else:
            out[r[0]] = r[1:]
    return out, square


def fit(rows: DataFrame, text_col: str = "text", values: int = VALUES, vocabulary: int = VOCABULARY, passes: int = PASSES, seed: int = 7) -> SvdEmbedder:
    """An embedder fitted on every row; null and empty texts teach nothing, an empty table gives an embedder of zero vectors.

    The vocabulary are the ``vocabulary`` most frequent words, ties by word. A pass reads the places of all texts' words; tasks hold a
    matrix of vocabulary x (values + ``MORE``) doubles and a strip of dense rows.
    """
    texts = stored(rows.select(F.col(text_col).cast("string").alias("text")), "embedder-texts")
    sums = S.word_sums(texts.select(T.analysed(F.col("text")).alias("_words")))
    vocab = S.most_frequent(sums, texts.count(), vocabulary).orderBy("term").collect()  # at most vocabulary rows
    terms, idf = [r.term for r in vocab], np.array([r.idf for r in vocab])
    if not terms:
        return SvdEmbedder([], np.zeros(0), np.zeros((0, values)), np.zeros(values), 0.0)
    model = SvdEmbedder(terms, idf, np.zeros((len(terms), 0)), np.zeros(0), 0.0)
    width = min(len(terms), values + MORE)
    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((len(terms), width)))[0]
    places = _placed(texts, model)
    for _ in range(passes):
        image, total = _product(places, model, basis)
        small = basis.T @ image
        basis, before = np.linalg.qr(image)[0], basis
    eigen, turn = np.linalg.eigh((small + small.T) / 2)
    first = np.argsort(-eigen)[:values]
    vectors = before @ turn[:, first]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(first))] < 0, -1.0, 1.0)  # one sign, whatever the run
    return SvdEmbedder(terms, idf, vectors, np.sqrt(np.maximum(eigen[first], 0)), total)
