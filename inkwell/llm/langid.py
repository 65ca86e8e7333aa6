"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows of ``WINDOW`` bytes; the network runs over each, forwards and backwards from a zero
state, across words and spaces, and labels every byte. The log probabilities of all positions of a
document, whole texts included, are averaged.

Training is backpropagation through time in numpy on windows at random places of a bounded, stratified sample
of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.scratch import small_batches
from inkwell.llm.tokens import mix, slices, text_buffers

WINDOW = 128
HIDDEN = 16
#: Windows that are labelled at once.
BATCH = 1024
#: Bound of the training sample: documents, dealt evenly to the labels, and windows of each.
TRAIN_DOCS, TRAIN_WINDOWS = 6000, 2
STEPS = 400
FLOOR = float(np.log(1e-6))


def windows(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and text numbers of the windows of texts with offsets ``off``."""
    size = np.diff(off)
    count = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = off[:-1][text] + k * WINDOW
    return start, np.minimum(WINDOW, off[1:][text] - start), text


class Network:
    """Weights of both directions and the output layer."""

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        # for each direction: input table of the 256 bytes for gates z, r and candidate c; recurrent weights
        self.w = {f"{d}{k}": draw(*s) for d in "fb" for k, s in (("E", (256, 3 * hidden)), ("Z", (hidden, 2 * hidden)), ("C", (hidden, hidden)))}
        self.w |= {"O": draw(2 * hidden, n_labels), "o": np.zeros(n_labels, np.float32)}
        self.hidden = hidden

    def states(self, x: np.ndarray, live: np.ndarray | None, d: str, keep: list | None = None) -> np.ndarray:
        """(T, B, H) states of one direction over (T, B) bytes; ``keep`` gathers what backpropagation needs.

        ``live`` masks the positions inside a window; None says that all are.
        """
        h_n, E, Z, C = self.hidden, self.w[d + "E"], self.w[d + "Z"], self.w[d + "C"]
        h = np.zeros((x.shape[1], h_n), E.dtype)
        out = np.zeros((*x.shape, h_n), E.dtype)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            e = E[x[t]]
            g = 1 / (1 + np.exp(-(e[:, : 2 * h_n] + h @ Z)))
            z, r = g[:, :h_n], g[:, h_n:]
            c = np.tanh(e[:, 2 * h_n :] + (r * h) @ C)
            new = h + z * (c - h)
            if live is not None:
                new = np.where(live[t][:, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, c))
            h = out[t] = new
        return out

    def label(self, x: np.ndarray, live: np.ndarray | None) -> np.ndarray:
        """(T, B, L) log probabilities of the labels at every position."""
        s = self.states(x, live, "f") @ self.w["O"][: self.hidden]
        s += self.states(x, live, "b") @ self.w["O"][self.hidden :]
        s += self.w["o"]
        s -= s.max(axis=2, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=2, keepdims=True))

    def pooled(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(n, L) log probabilities of texts in a buffer, no less than ``FLOOR``, summed over their positions."""
        start, size, text = windows(off)
        out = np.zeros((len(off) - 1, len(self.w["o"])))
        full = size == WINDOW
        for group in (np.flatnonzero(full), np.flatnonzero(~full)[np.argsort(size[~full], kind="stable")]):
            for k in range(0, len(group), BATCH):
                part = group[k : k + BATCH]
                width = int(size[part].max())
                at = np.arange(width)[:, None]
                live = None if full[part[0]] else at < size[part][None, :]
                x = raw[np.minimum(start[part][None, :] + at, len(raw) - 1)]
                p = np.maximum(self.label(x, live), FLOOR)
                np.add.at(out, text[part], (p if live is None else p * live[:, :, None]).sum(axis=0, dtype=np.float64))
        return out

    def gradient(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over live positions and its gradient by backpropagation through time."""
        h_n, keep = self.hidden, {"f": [], "b": []}
        both = np.concatenate([self.states(x, live, d, keep[d]) for d in "fb"], axis=2)
        s = both @ self.w["O"] + self.w["o"]
        p = np.exp(s - s.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        total = live.sum()
        loss = -np.log(p[:, np.arange(len(y)), y] + 1e-9)[live].sum() / total
        ds = p
        ds[:, np.arange(len(y)), y] -= 1
        ds *= live[:, :, None] / total
        g = {"O": np.einsum("tbh,tbl->hl", both, ds), "o": ds.sum(axis=(0, 1))}
        dboth = ds @ self.w["O"].T
        for d, lo in (("f", 0), ("b", h_n)):
            E, Z, C = np.zeros((256, 3 * h_n), dboth.dtype), np.zeros_like(self.w[d + "Z"]), np.zeros_like(self.w[d + "C"])
            dh = np.zeros((x.shape[1], h_n), dboth.dtype)
            into = np.zeros((*x.shape, 3 * h_n), dboth.dtype)
            for t, h, z, r, c in reversed(keep[d]):
                dh = dh + dboth[t, :, lo : lo + h_n]
                on = live[t][:, None]
                dn = np.where(on, dh, 0)
                da = dn * z * (1 - c * c)
                drh = da @ self.w[d + "C"].T
                dg = np.concatenate([dn * (c - h) * z * (1 - z), drh * h * r * (1 - r)], axis=1)
                C += (r * h).T @ da
                Z += h.T @ dg
                into[t] = np.concatenate([dg, da], axis=1)
                dh = np.where(on, dn * (1 - z) + drh * r + dg @ self.w[d + "Z"].T, dh)
            flat, order = x.ravel(), np.argsort(x, axis=None, kind="stable")
            used, first = np.unique(flat[order], return_index=True)
            E[used] = np.add.reduceat(into.reshape(-1, 3 * h_n)[order], first)
            g |= {d + "E": E, d + "Z": Z, d + "C": C}
        return float(loss), g


def pad(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(T, B) bytes and the mask of those inside the texts."""
    size = np.array([len(w) for w in texts])
    width = int(size.max())
    x = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in texts), np.uint8).reshape(len(texts), width).T
    return np.ascontiguousarray(x), np.arange(width)[:, None] < size[None, :]


def train(texts: list[bytes], labels: np.ndarray, n_labels: int, steps: int = STEPS, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam over batches that draw every label alike; the same input gives the same network."""
    net, rng = Network(n_labels, seed=seed), np.random.Generator(np.random.PCG64(seed + 1))
    of = [np.flatnonzero(labels == k) for k in range(n_labels)]
    m, v = {k: 0.0 for k in net.w}, {k: 0.0 for k in net.w}
    for step in range(1, steps + 1):
        part = [int(rng.choice(of[(step * batch + i) % n_labels])) for i in range(batch)]
        _, g = net.gradient(*pad([texts[i] for i in part]), labels[part])
        for key, d in g.items():
            m[key] = 0.9 * m[key] + 0.1 * d
            v[key] = 0.99 * v[key] + 0.01 * d * d
            net.w[key] = (net.w[key] - rate * (1 - 0.9 * step / steps) * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def sample(docs: DataFrame, text_col: str, label_col: str, order_col: str, max_docs: int, max_windows: int) -> list:
    """Rows ``(h, label, window)`` of a stratified sample: at most ``max_docs`` documents in all, alike for each label.

    Of each label the documents of smallest hash of id and text are drawn, one at least; of each, windows at
    places drawn by that hash from the whole text. Only windows reach the driver.
    """
    named = docs.where(F.col(label_col).isNotNull() & (F.length(F.col(text_col).cast("string")) > 0))
    rows = named.select(F.col(label_col).cast("string").alias("label"), F.xxhash64(F.col(order_col).cast("string"), F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    # each label's smallest hashes; a hash that repeats is one document
    known = rows.select("label", "h").distinct()
    labels = known.select("label").distinct().count()
    first = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    chosen = known.withColumn("_r", first).where(F.col("_r") <= max(1, max_docs // max(1, labels))).drop("_r")
    # at most max_docs rows; one a label if there are more labels than that, which then meet by a shuffle
    rows = rows.join(F.broadcast(chosen) if labels <= max_docs else chosen, ["label", "h"], "left_semi").dropDuplicates(["label", "h"]).select("h", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for h, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                spots = mix(np.arange(max_windows, dtype=np.uint64) + np.uint64(h & (2**64 - 1))) % np.uint64(max(1, len(raw) - WINDOW + 1))
                for a in sorted(set(spots.tolist())):
                    for col, x in zip(out, (h, label, raw[a : a + WINDOW])):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.binary()))], names=["h", "label", "window"])

    return sorted((r.h, r.label, bytes(r.window)) for r in rows.mapInArrow(run, "h long, label string, window binary").collect())


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", order_col: str = "doc_id", max_docs: int = TRAIN_DOCS, max_windows: int = TRAIN_WINDOWS, steps: int = STEPS) -> tuple[Network, list[str]] | None:
    """A network and its labels from rows with text and label; None if there are none.

    The sample (see ``sample``) has every label that the table has and bounds what the driver holds; prediction knows
    no such bound. Null and empty texts and null labels teach nothing; rows that repeat id and text are drawn together.
    """
    rows = sample(docs, text_col, label_col, order_col, max_docs, max_windows)
    if not rows:
        return None
    labels = sorted({label for _, label, _ in rows})
    return train([w for _, _, w in rows], np.array([labels.index(label) for _, label, _ in rows]), len(labels), steps), labels


def predict(docs: DataFrame, model: tuple[Network, list[str]] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, lang_pred, score)`` of every row from its text alone.

    ``lang_pred`` is the label of the largest pooled probability, the first in order on a tie, and ``score``
    its softmax over mean log probabilities of a position, to six digits. Null text, text without a letter, or no
    model: ``und`` and 0. Texts of any length are labelled whole. Repeated rows and null ids stay; other columns are
    ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("spoken", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model[0].w, model[0].hidden, model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, hidden, labels = shared.value
        net = Network(len(labels), hidden)
        net.w = weights
        for batch in batches:
            for x, y in slices(batch.column(1)):
                part = batch.slice(x, y - x)
                raw, off = text_buffers(part.column(1))
                mean = net.pooled(raw, off) / np.maximum(np.diff(off), 1)[:, None]
                best = mean.argmax(axis=1)
                score = np.round(1 / np.exp(mean - mean.max(axis=1, keepdims=True)).sum(axis=1), 6)
                spoken = part.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([labels[b] if s else "und" for b, s in zip(best, spoken)], pa.string()), pa.array([float(v) if s else 0.0 for v, s in zip(score, spoken)], pa.float64())], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
