"""Texts are cut in tasks, slice by slice, and no token is a row of the plan but those with a final period."""

import pyarrow as pa

from inkwell.operators import punkt

from .test_punkt import corpus


def test_slices_give_what_the_whole_gives(spark, monkeypatch):
    texts = [*corpus()[:40], "See (Fig. 2) here!\" Then\x0bmore?) “Éa 1.5 x.” ... J. Smith, z. B. das", "", " \n", None, "one", "a.b.. c!? .. d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model = punkt.fit(docs)
    want = sorted(map(tuple, punkt.sentences(docs, model).collect()))
    assert "Generate" not in punkt.sentences(docs, model)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(punkt, "SLICE", 50)
    again = punkt.fit(docs)
    for name in ("types", "abbreviations", "starters", "collocations", "spellings"):
        assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(model, name).collect()))
    assert sorted(map(tuple, punkt.sentences(docs, again).collect())) == want
    marks = sorted((r.doc_id, r.pos) for r in punkt.breaks(docs, model).where("breaks").collect())
    ends = {}
    for i, _, n, _ in want:
        ends.setdefault(i, []).append(n + (ends[i][-1] if ends.get(i) else 0))
    assert marks == [(i, e - 1) for i, es in sorted(ends.items()) for e in es[:-1]]


def test_tokens_of_texts():
    t = punkt.Tokens(pa.array(["dropped", "Fig. 2 (end.)", "", " ", "a!\" B?x 1,5. Éa... «"]).slice(1))
    typ, cut = [t.types[t.typ[k]].as_py() for k in t.kind], lambda flags: flags[t.kind].tolist()
    assert typ == ["fig", "##", "end", "a!", "b?x", "##", "éa..", ""] and t.text.tolist() == [0, 0, 0, 3, 3, 3, 3, 3] and t.pos.tolist() == [0, 1, 2, 0, 1, 2, 3, 4]
    assert cut(t.per) == [True, False, True, False, False, True, True, False] and cut(t.dots) == [False] * 6 + [True, False]
    assert cut(t.bang) == [False] * 3 + [True] + [False] * 4 and cut(t.cap) == [True, False, False, False, True, False, True, False]
    assert cut(t.odd) == [False, True, False, False, False, True, False, False] and cut(t.word) == [True] * 7 + [False]
