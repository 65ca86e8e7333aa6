"""Sentence boundaries learned from the corpus without labels (Kiss and Strunk, 2006).

Three likelihood ratios over counts of the whole corpus make the model: words that go with a period more than chance
has it are abbreviations; words that follow sure ends too often are sentence starters; pairs of a number or an
initial with a following word that stand together too often don't part. How a word is spelled elsewhere, small or large,
decides the rest. Texts are cut in tasks, slice by slice: what a token looks like is found once for each distinct one of a slice, and counts
are combined before their shuffle. The model is tables of word types.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.scopes import slices
from inkwell.operators.tables import small, small_batches, stored

# The published thresholds
ABBREVIATION, STARTER, COLLOCATION, SURE = 0.3, 30.0, 7.88, 0.99

#: Bytes of text that are cut at once: the more, the fewer distinct tokens there are for their number.
SLICE = 8_000_000

CLOSERS = "[\"'’”»)\\]}]+$"
OPENERS = r"^[^\p{L}\p{N}]+"
NUMBER = r"^[0-9]+([.,][0-9]+)*$"


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Tokens:
    """Runs of non-space characters of some texts: ``kind``, the number of each among the distinct ones, ``text``, the place of its text, and ``pos``, its place there.

    Of the distinct ones: ``typ``, the word type, in lower case and without a final period, numbers being one type, as a number among ``types``; ``per`` says
    that a period ends it, ``dots`` that several do, ``bang`` and ``stop`` that its last mark is one of ``!?`` or a period; ``odd`` that the type is a number or one letter; ``cap``,
    ``low`` and ``word`` how it begins.
    """

    def __init__(self, texts: pa.StringArray):
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        first = off[:-1] - off[0]
        inside = ~_SPACE[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        heads = first[first < len(data)]
        opens[heads] = inside[heads]
        at, ends = np.flatnonzero(opens), np.cumsum(inside, dtype=np.int64)
        offsets = np.append(ends[at] - 1, ends[-1] if len(ends) else 0).astype(np.int32)
        found = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
        self.kind, self.text = found.indices.to_numpy().astype(np.int64), np.searchsorted(first, at, "right") - 1
        self.pos = np.arange(len(at)) - np.searchsorted(self.text, self.text)
        cut = lambda x, pattern: pc.replace_substring_regex(x, pattern, "")
        is_ = lambda x: x.to_numpy(zero_copy_only=False)
        token = found.dictionary
        bare, last, core = cut(token, OPENERS), cut(token, CLOSERS), cut(cut(pc.utf8_lower(token), CLOSERS), OPENERS)
        self.stop, self.bang = is_(pc.ends_with(last, ".")), is_(pc.or_(pc.ends_with(last, "!"), pc.ends_with(last, "?")))
        self.per, self.dots = is_(pc.ends_with(core, ".")), is_(pc.ends_with(core, ".."))
        typ = cut(core, r"\.$")
        typ = pc.if_else(pc.match_substring_regex(typ, NUMBER), IS_NUMBER, typ).dictionary_encode()
        self.typ, self.types = typ.indices.to_numpy().astype(np.int64), typ.dictionary
        self.odd = is_(pc.or_(pc.equal(self.types, IS_NUMBER), pc.match_substring_regex(self.types, r"^\p{L}$")))[self.typ]
        self.cap, self.low, self.word = (is_(pc.match_substring_regex(bare, p)) for p in (r"^\p{Lu}", r"^\p{Ll}", r"^[\p{L}\p{N}]"))

    def named(self, typ: np.ndarray) -> pa.StringArray:
        return self.types.take(pa.array(typ))


def _each_slice(docs: DataFrame, columns: list, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on slices of the rows with a text, which is the last of ``columns``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False), SLICE):
                yield from work(batch.slice(a, b - a)).to_batches()

    return docs.select(*columns).where(F.col(docs.select(*columns).columns[-1]).isNotNull()).mapInArrow(run, schema)


COUNTS = "typ string, n_typ string, per long, plain long, n long, low boolean, cap boolean, mid_cap boolean, low_after boolean, after long, starts long"


def _counts(batch: pa.RecordBatch) -> pa.Table:
    """Two kinds of rows: of each type, as ``n_typ`` with a null ``typ``, how often it stands with a period and without, and what is known of it as a following
    type without the abbreviations; of two types, where a period ends the former, what its being an abbreviation decides."""
    t = Tokens(batch.column(0))
    names, kinds = [c.split()[0] for c in COUNTS.split(", ")], len(t.types)
    count = lambda at, x=None, n=kinds: np.bincount(at, x, minlength=n).astype(np.int64)

    def rows(**columns) -> pa.Table:
        n = len(next(iter(columns.values())))
        kept = {"per": np.zeros(n, np.int64), "plain": np.zeros(n, np.int64), "n": np.zeros(n, np.int64), "after": np.zeros(n, np.int64), "starts": np.zeros(n, np.int64)} | {c: np.zeros(n, bool) for c in ("low", "cap", "mid_cap", "low_after")} | columns
        return pa.table([pa.array(kept[c]) if c in kept else pa.nulls(n, pa.string()) for c in names], names=names)

    typ = t.typ[t.kind]
    every, per = count(typ), count(typ, t.per[t.kind])
    near = np.flatnonzero(t.text[1:] == t.text[:-1])
    a, b = t.kind[near], t.kind[near + 1]
    asks = t.per[a] & ~t.dots[a]
    x, y = a[~asks], b[~asks]
    to = t.typ[y]
    some = lambda flags: count(to, flags) > 0
    alone = rows(n_typ=t.types, per=per, plain=every - per, low=some(t.low[y]), cap=some(t.cap[y]), mid_cap=some(t.cap[y] & ~t.stop[x] & ~t.bang[x]), low_after=some(t.low[y] & t.bang[x]), after=count(to, t.bang[x]), starts=count(to, t.bang[x] & ~t.odd[x]))
    x, y = a[asks], b[asks]
    pairs, place, n = np.unique(t.typ[x] * kinds + t.typ[y], return_inverse=True, return_counts=True)
    some = lambda flags: count(place, flags, len(pairs)) > 0
    own, to = np.divmod(pairs, max(kinds, 1))
    both = rows(typ=t.named(own), n_typ=t.named(to), n=n, low=some(t.low[y]), cap=some(t.cap[y]))
    return pa.concat_tables([alone, both])


def _lean(n: Column, ab: Column, p: Column) -> Column:
    return ab * F.log(p) + (n - ab) * F.log(1 - p)


def abbreviation_score(per: Column, plain: Column, typ: Column, periods: Column, tokens: Column) -> Column:
    """The ratio of "nearly always with a period" to "as often as any word", weighed by length, inner periods and bare uses."""
    n, p = per + plain, F.try_divide(periods, tokens)
    ratio = -2 * (_lean(n, per, p) - _lean(n, per, F.lit(SURE)))
    inner = F.length(typ) - F.length(F.replace(typ, F.lit("."), F.lit("")))
    letters = F.length(typ) - inner
    return ratio * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -plain.cast("double"))


def together(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Log-likelihood ratio of two events of counts a and b, ab of them together, among n."""
    p, p1, p2 = F.try_divide(b, n), F.try_divide(ab, a), F.try_divide(b - ab, n - a)
    inside = lambda q, x: F.when((q > 0) & (q < 1), x).otherwise(0.0)
    rest = n - a - b + ab
    return -2 * (_lean(a, ab, p) + (b - ab) * F.log(p) + rest * F.log(1 - p) - inside(p1, _lean(a, ab, p1)) - inside(p2, (b - ab) * F.log(p2) + rest * F.log(1 - p2)))


@dataclass
class Model:
    """Written tables: types and their counts, abbreviations among them, starters, collocations, and spellings."""

    types: DataFrame
    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    spellings: DataFrame


IS_NUMBER = "##"


def _initial() -> Column:
    return F.col("typ").rlike(r"^\p{L}$")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts over all documents; null texts count for nothing, a corpus without a period has no abbreviation."""
    some, total = ("low", "cap", "mid_cap", "low_after"), ("per", "plain", "n", "after", "starts")
    every = _each_slice(docs, [F.col(text_col).cast("string")], _counts, COUNTS).groupBy("typ", "n_typ")
    every = stored(every.agg(*[F.sum(c).alias(c) for c in total], *[F.max(c).alias(c) for c in some]), "punkt-counts")
    counts = every.where("typ IS NULL").select(F.col("n_typ").alias("typ"), "per", "plain")
    tokens, periods = counts.agg(F.sum(F.col("per") + F.col("plain")), F.sum("per")).first()
    tokens, periods = tokens or 0, periods or 0
    n = F.lit(tokens)
    score = F.round(abbreviation_score(F.col("per"), F.col("plain"), F.col("typ"), F.lit(periods), n), 6)
    abbreviations = counts.where((F.col("per") > 0) & F.col("typ").rlike(r"\p{L}") & F.lit(0 < periods < tokens)).withColumn("score", score).where(F.col("score") >= ABBREVIATION)
    abbreviations = stored(abbreviations.select("typ", "score"), "punkt-abbreviations")
    odd = (F.col("typ") == IS_NUMBER) | _initial()
    # after a period an end is sure unless the type is an abbreviation
    rows = every.where("typ IS NOT NULL").join(small(abbreviations.select("typ", F.lit(True).alias("abbr"))), "typ", "left")
    rows = rows.withColumn("sure", F.col("abbr").isNull())
    known = rows.select("n_typ", "low", "cap", F.lit(False).alias("mid_cap"), (F.col("low") & F.col("sure")).alias("low_after"), F.when(F.col("sure"), F.col("n")).otherwise(0).alias("after"), F.when(F.col("sure") & ~odd, F.col("n")).otherwise(0).alias("starts"))
    # for each following type how often it is spelled small and large, and how often it follows a sure end
    seen = every.where("typ IS NULL").select(known.columns).unionByName(known).groupBy("n_typ").agg(*[F.max(c).alias(c) for c in some], F.sum("after").alias("after"), F.sum("starts").alias("starts"))
    seen = stored(seen, "punkt-spellings")
    ends = seen.agg(F.sum("after")).first()[0] or 0
    known = counts.select(F.col("typ").alias("n_typ"), (F.col("per") + F.col("plain")).alias("uses"))
    starters = seen.where((F.col("starts") > 0) & F.col("n_typ").rlike(r"\p{L}")).join(known, "n_typ").where((F.col("uses") >= F.col("starts")) & F.lit(0 < ends < tokens))
    starters = starters.withColumn("score", F.round(together(F.lit(ends), F.col("uses"), F.col("starts"), n), 6))
    starters = starters.where((F.col("score") >= STARTER) & (n * F.col("starts") > F.col("uses") * ends))
    pair = rows.where(F.col("sure") & odd & (F.col("n_typ") != "")).select("typ", "n_typ", F.col("n").alias("both")).where("both > 1")
    pair = pair.join(known.select(F.col("n_typ").alias("typ"), F.col("uses").alias("a")), "typ").join(known.withColumnRenamed("uses", "b"), "n_typ")
    pair = pair.where("both <= least(a, b)").withColumn("score", F.round(together(F.col("a"), F.col("b"), F.col("both"), n), 6))
    pair = pair.where((F.col("score") >= COLLOCATION) & (n * F.col("both") > F.col("a") * F.col("b")))
    return Model(counts, abbreviations, stored(starters.select("n_typ", "score"), "punkt-starters"), stored(pair.select("typ", "n_typ", "score"), "punkt-pairs"), seen.select("n_typ", "low", "cap", "mid_cap", "low_after"))


def _asking(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """Rows of tokens with a final period and another behind them, with ``brk``: whether a sentence ends there. The tables meet these few tokens only."""

    def work(batch: pa.RecordBatch) -> pa.Table:
        t = Tokens(batch.column(1))
        at = np.flatnonzero((t.text[1:] == t.text[:-1]) & t.stop[t.kind[:-1]])
        a, b = t.kind[at], t.kind[at + 1]
        columns = [batch.column(0).take(pa.array(t.text[at])), pa.array(t.pos[at], pa.int32()), t.named(t.typ[a]), pa.array(t.dots[a]), t.named(t.typ[b]), *(pa.array(x[b]) for x in (t.cap, t.low, t.word))]
        return pa.table(columns, names=[id_col, "pos", "typ", "dots", "n_typ", "n_cap", "n_low", "n_word"])

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, pos int, typ string, dots boolean, n_typ string, n_cap boolean, n_low boolean, n_word boolean"
    rows = _each_slice(docs, [F.col(id_col), F.col(text_col).cast("string").alias("_t")], work, schema)
    rows = rows.join(small(model.abbreviations.select("typ", F.lit(True).alias("abbr"))), "typ", "left")
    rows = rows.join(small(model.spellings), "n_typ", "left")
    rows = rows.join(small(model.starters.select("n_typ", F.lit(True).alias("starter"))), "n_typ", "left")
    rows = rows.join(small(model.collocations.select("typ", "n_typ", F.lit(True).alias("tied"))), ["typ", "n_typ"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    begins = yes("n_cap") & yes("low") & ~yes("mid_cap")
    goes_on = ~yes("n_word") | (yes("n_low") & (yes("cap") | ~yes("low_after")))
    initial = _initial()
    brk = (
        F.when(yes("tied"), False)
        .when((yes("abbr") | F.col("dots")) & ~initial, begins | (yes("n_cap") & yes("starter")))
        .when(initial | (F.col("typ") == IS_NUMBER), begins | (~goes_on & ~(initial & yes("n_cap") & ~yes("low"))))
        .otherwise(True)
    )
    return rows.withColumn("brk", brk)


def _ends_apart(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """``(id, ends)``: of each text with such, the ascending places of the tokens that end a sentence by a period."""
    asking = _asking(docs, model, id_col, text_col)
    return asking.where("brk").groupBy(id_col).agg(F.sort_array(F.collect_list("pos")).alias("ends"))


def _tokens_and_breaks(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """``(id, toks, ends)``: a text's tokens and the places of all that end a sentence. Tokens stay in the row of their text."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(r"\S+"), F.lit(0))
    rows = docs.select(id_col, F.col(text_col)).join(_ends_apart(docs, model, id_col, text_col), id_col, "left")
    marked = lambda ts: F.filter(F.transform(ts, lambda t, i: F.when((i < F.size(ts) - 1) & F.regexp_replace(t, CLOSERS, "").rlike("[!?]$"), i)), lambda i: i.isNotNull())
    rows = rows.select(id_col, found.alias("toks"), F.coalesce("ends", F.array().cast("array<int>")).alias("by_period")).where(F.size("toks") > 0)
    return rows.select(id_col, "toks", F.array_sort(F.concat(F.get(F.transform(F.array("toks"), marked), 0), "by_period")).alias("ends"))


def _sentence_tokens(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """``(id, pos, start, toks, final)``: the tokens of each sentence, the place of its first one, and whether it is the text's last."""
    rows = _tokens_and_breaks(docs, model, id_col, text_col).select(id_col, "toks", F.concat(F.array(F.lit(-1)), "ends", F.array(F.size("toks") - 1)).alias("edges"))
    own = F.transform(F.arrays_zip(F.slice("edges", 1, F.size("edges") - 1).alias("a"), F.slice("edges", 2, F.size("edges") - 1).alias("b")), lambda z: F.struct((z["a"] + 1).alias("start"), F.slice("toks", z["a"] + 2, z["b"] - z["a"]).alias("toks"), (z["b"] == F.size("toks") - 1).alias("final")))
    return rows.select(id_col, F.posexplode(own).alias("pos", "s")).select(id_col, "pos", "s.*")


def breaks(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, tok, breaks)`` of every token: whether a sentence ends with it and another begins."""
    rows = _sentence_tokens(docs, model, id_col, text_col)
    rows = rows.select(id_col, "start", "final", F.size("toks").alias("n"), F.posexplode("toks").alias("k", "tok"))
    return rows.select(id_col, (F.col("start") + F.col("k")).alias("pos"), "tok", ((F.col("k") == F.col("n") - 1) & ~F.col("final")).alias("breaks"))


_MARKED = re.compile(r"[!?][\"'’”»)\]}]*$")


def _parts(text: bytes, ends: list[int]) -> Iterator[list[bytes]]:
    """The tokens of each sentence; ``ends`` are the places of those that end one by a period."""
    toks = text.split()
    if not toks:
        return
    marked = [i for i, t in enumerate(toks[:-1]) if (b"!" in t or b"?" in t) and _MARKED.search(t.decode())] if b"!" in text or b"?" in text else []
    at = 0
    for end in [*sorted([*ends, *marked]), len(toks) - 1]:
        yield toks[at : end + 1]
        at = end + 1


def sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, n_words, sent)``: sentences in order, white space inside them collapsed; ids must not repeat."""
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_t")).join(_ends_apart(docs, model, id_col, text_col), id_col, "left")

    def work(batch: pa.RecordBatch) -> pa.Table:
        row, pos, n, sent = [], [], [], []
        for i, (ends, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist())):
            for k, toks in enumerate(_parts(text, ends or [])):
                row.append(i)
                pos.append(k)
                n.append(len(toks))
                sent.append(b" ".join(toks))
        return pa.table([batch.column(0).take(pa.array(row, pa.int64())), pa.array(pos, pa.int64()), pa.array(n, pa.int64()), pa.array(sent, pa.binary()).cast(pa.string())], names=[id_col, "pos", "n_words", "sent"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _each_slice(rows, [F.col(id_col), F.col("ends"), F.col("_t")], work, f"{id_col} {kind}, pos long, n_words long, sent string")
