"""Terms as numbers, slice by slice: the same as text by text, in bounded batches."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.lexicons import CONNECTORS, STOP_WORDS
from inkwell.operators import scopes
from inkwell.operators import similarity as S

ODD = ["", " ", "a b c", "Ünïcode wörds größer_2 x1 日本語テスト 😀😀 𝒜𝒷𝒸", "one\x0btwo three four", "_ __ ___", "tail9", "9head éa \U0001d7d8\U0001d7d9"]
TEXT = "The alpha model learns. Alpha beta, gamma alpha beta!  \n\nThen one gamma? y.  "


def test_words_are_those_of_the_column(spark):
    texts = [*ODD, TEXT, "x", ""]
    want = [r.w for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").select(T.analysed(F.col("t")).alias("w")).collect()]
    words, codes, text = scopes.numbered_words(pa.array(["dropped", *texts]).slice(1))
    got = [[] for _ in texts]
    for c, t in zip(codes.tolist(), text.tolist()):
        got[t].append(words[c].as_py())
    assert got == want and words.to_pylist() == sorted(words.to_pylist(), key=str.encode)


def ranked(texts):
    """Terms, scores and ranks by the definition, without arrays."""
    units = [(pos, s) for t in texts for pos, s in scopes.sentences_of(t.encode())]
    counts, n = defaultdict(Counter), len(units)
    for pos, s in units:
        words = [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in s.decode().lower()).split() if len(w) > 1 and w not in STOP_WORDS]
        counts[pos].update([*words, *map(" ".join, zip(words, words[1:]))])
    df = Counter(t for c in counts.values() for t in c)
    sums = Counter()
    for c in counts.values():
        w = {t: tf * (math.log((1 + n) / (1 + df[t])) + 1) for t, tf in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            sums[t] += x / norm
    order = sorted(sums, key=lambda t: (-round(sums[t], 6), -len(t.split()), t.encode()))
    return [(t, round(sums[t], 6), k) for k, t in enumerate(order, 1)]


def folded(terms, top):
    chosen = []
    for t in terms:
        if len(chosen) < top and not any(set(t.split()) <= set(k.split()) for k in chosen):
            chosen.append(t)
    return list(enumerate(chosen))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [*"alpha beta gamma delta the of ab abc ab_c größe x".split(), *(f"w{k}" for k in range(20))]
    plain = [". ".join(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    return {i: [t] for i, t in enumerate([*ODD[:4], TEXT, *plain])} | {900: [TEXT, plain[0], "alpha. beta"], 901: ["zeta"]}


@pytest.mark.parametrize("size", [1, 300, 2_000_000])
def test_slices_give_what_the_whole_gives(spark, monkeypatch, texts, size):
    monkeypatch.setattr(scopes, "SLICE", size)
    docs = spark.createDataFrame([(i, t) for i, ts in texts.items() for t in ts] + [(902, None)], "doc_id long, text string")
    got = defaultdict(list)
    for r in S.keyword_scores(docs).orderBy("doc_id", "rank").collect():
        got[r.doc_id].append((r.term, r.score, r["rank"]))
    want = {i: rows for i, ts in texts.items() if (rows := ranked(ts))}
    assert got == want
    best = defaultdict(list)
    for r in S.keywords(docs, top=4).orderBy("doc_id", "place").collect():
        best[r.doc_id].append((r.place, r.term))
    assert best == {i: folded([x[0] for x in rows], 4) for i, rows in want.items()}


def stepped(texts, floor=0.05):
    """Transitions of one text's paragraphs by the definition."""
    paras = [p.decode() for _, p in scopes.paragraphs_of(texts.encode())]
    bags = [Counter(w for w in "".join(c if c.isalnum() or c == "_" else " " for c in p.lower()).split() if len(w) > 1 and w not in STOP_WORDS) for p in paras]
    df = Counter(t for c in bags for t in c)
    vectors = [{t: tf * (math.log((1 + len(bags)) / (1 + df[t])) + 1) for t, tf in c.items()} for c in bags]
    norm = [math.sqrt(sum(x * x for x in v.values())) or 1 for v in vectors]
    q = [round(1e6 * sum(w * b.get(t, 0) for t, w in a.items()) / m / n) for a, b, m, n in zip(vectors, vectors[1:], norm, norm[1:])]
    if not q:
        return []
    level = round(max(floor, (sum(q) - 0.75 * math.sqrt(len(q) * sum(x * x for x in q) - sum(q) ** 2)) / (len(q) * 1e6)), 6)
    linked = [any(f" {c} " in " " + " ".join(x.strip(".,;:").lower() for x in p.split()[:6]) + " " for c in CONNECTORS) for p in paras[1:]]
    return [(i, x / 1e6, level, on, x / 1e6 < level and not on) for i, (x, on) in enumerate(zip(q, linked))]


@pytest.mark.parametrize("size", [1, 2_000_000])
def test_transitions_by_the_definition(spark, monkeypatch, size):
    monkeypatch.setattr(scopes, "SLICE", size)
    rng = random.Random(8)
    words = [*"alpha beta größe the of However, Moreover; result".split(), *(f"w{k}" for k in range(9))]
    para = lambda: " ".join(rng.choices(words, k=rng.randint(3, 12)))
    texts = [rng.choice(["\n", "\n\n", " \n \t\n "]).join(para() for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts += ["", " \n\n ", "one two three four five", "the of and to in\n\nthe of and to in", "  alpha beta w1 w2 w3 \n\n\tHowever, alpha beta w1 w2"]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    got = defaultdict(list)
    for r in S.cohesion(docs).orderBy("doc_id", "pos").collect():
        got[r.doc_id].append((r.pos, r.similarity, r.threshold, r.linked, r.weak))
    assert got == {i: rows for i, t in enumerate(texts) if (rows := stepped(t))}


def test_cohesion_is_one_pass_in_tasks(spark, monkeypatch):
    """No paragraph, connector or term is an expression of the plan, and batches are worked on in slices."""
    plan = S.cohesion(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "however" not in plan.lower()


@pytest.mark.parametrize("work", [scopes.scored_terms, scopes.chosen_terms(8)])
def test_a_task_works_on_slices_of_its_batches(spark, work):
    """Batches of any number of rows: neither what is worked on nor what is returned at once grows with them."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("alpha beta gamma delta. " * 100).alias("text")).coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        if sum(len(t) for ts in rows for t in ts) > scopes.SLICE + 2400:
            seen.add(1)
        return work(rows)

    columns = "term string, score double, rank long" if work is scopes.scored_terms else "place long, term string"
    assert scopes.by_rows(docs, "doc_id", "text", counted, columns).select("doc_id").distinct().count() == 3000
    assert seen.value == 0 and "ArrowEvalPython" not in S.keyword_scores(docs)._jdf.queryExecution().executedPlan().toString()
