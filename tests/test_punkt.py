"""The learned sentence boundaries on a small corpus with known abbreviations."""

import math
import random

from inkwell.operators import punkt


def corpus():
    rng = random.Random(3)
    words = "we show that the method gives results on data and they hold for many cases while others vary".split()
    out = []
    for i in range(150):
        plain = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(5, 9)))
        head = rng.choice(["The", "We", "They", "Results"])
        out.append(f"{head} {plain()}. See Fig. {rng.randint(1, 9)} for {plain()}. As Smith et al. (2019) say, {plain()}. Wir zeigen, z. B. hier, {plain()}. The {plain()}! Is it {plain()}? We {plain()}.")
    return out


def split(spark, texts, extra=()):
    docs = spark.createDataFrame(list(enumerate([*texts, *extra])), "doc_id long, text string")
    model = punkt.fit(docs)
    rows = punkt.sentences(docs, model).orderBy("doc_id", "pos").collect()
    out = {}
    for r in rows:
        assert r.pos == len(out.setdefault(r.doc_id, [])) and r.n_words == len(r.sent.split())
        out[r.doc_id].append(r.sent)
    return model, out


def test_abbreviations_dont_split(spark):
    texts = corpus()
    extra = ["See Fig. 2 here. It is Smith et al. (2019) again.", "Das ist z. B. so.", "Mr Smith went.  He\nsat down", "", None, "one two", "(It ended.) Then more."]
    model, got = split(spark, texts, extra)
    found = {r.typ for r in model.abbreviations.collect()}
    assert {"fig", "al"} <= found and not found & {"data", "results", "cases", "vary"}
    n = len(texts)
    assert got[n] == ["See Fig. 2 here.", "It is Smith et al. (2019) again."] and got[n + 1] == ["Das ist z. B. so."]
    assert got[n + 2] == ["Mr Smith went.", "He sat down"] and n + 3 not in got and n + 4 not in got and got[n + 5] == ["one two"] and got[n + 6] == ["(It ended.)", "Then more."]
    assert all(len(got[i]) == 7 for i in range(n))
    assert all(" ".join(got[i]) == " ".join(texts[i].split()) for i in range(n))


def test_scores_by_hand(spark):
    docs = spark.createDataFrame([(0, "the fig. a the fig. b the end. the fig. c the")], "doc_id long, text string")
    model = punkt.fit(docs)
    n, b = 12, 4
    count = {(r.typ): (r.per, r.plain) for r in model.types.collect()}
    assert sum(map(sum, count.values())) == n and count["fig"] == (3, 0) and count["the"] == (0, 5)
    lean = lambda k, ab, p: ab * math.log(p) + (k - ab) * math.log(1 - p)
    want = -2 * (lean(3, 3, b / n) - lean(3, 3, 0.99)) * math.exp(-3)
    assert (want >= 0.3) == ("fig" in {r.typ for r in model.abbreviations.collect()}) and abs(want - 0.3251) < 0.005
    assert punkt.fit(docs.limit(0)).abbreviations.count() == 0


def test_tables_beyond_a_broadcast_meet_asking_tokens_only(spark, monkeypatch):
    from inkwell.operators import punkt

    text = "He met Dr. Smith at noon. They talked of fig. 3 and left! Was it 1990. Then they went home (really?) and slept."
    docs = spark.createDataFrame([(i, text) for i in range(30)] + [(90, "one"), (91, " "), (92, None)], "doc_id long, text string")
    model = punkt.fit(docs)
    want = sorted(punkt.sentences(docs, model).collect())
    monkeypatch.setattr(punkt, "small", lambda t: t)
    rows = punkt.sentences(docs, punkt.fit(docs))
    assert sorted(rows.collect()) == want and {r.doc_id for r in want} == {*range(30), 90}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # no table of tokens is dealt by a type that is null for most of them, none is sorted by place
    assert "asked" not in plan and "Window" not in plan
    at = {(r.pos, r.tok) for r in punkt.breaks(docs, model).where("doc_id = 0 AND breaks").collect()}
    assert (12, "left!") in at and len(at) == len([r for r in want if r.doc_id == 0]) - 1
