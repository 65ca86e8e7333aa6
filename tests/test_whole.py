"""Blocks, whole results and branches that the tables don't reach."""

import numpy as np

from inkwell.operators import similarity as S
from inkwell.plans import catalogue

from .test_catalogue import SF


def test_dense_topk_runs_every_query(spark):
    got = catalogue.QUERIES["dense_topk"](spark, SF)
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in v]), np.array([r.embedding for r in v], np.float64)
    want = []
    for i in np.nonzero(ids % 20 == 0)[0]:
        s = np.round(x @ x[i], 6)
        best = [j for j in np.lexsort((ids, -s)) if j != i][:4]
        want += [(int(ids[i]), int(ids[j]), round(float(s[j]), 5), n + 1) for n, j in enumerate(best)]
    assert len({w[0] for w in want}) == 25
    assert sorted((r.query_id, r.vec_id, round(r.similarity, 5), r["rank"]) for r in got.collect()) == sorted(want)


def test_dense_topk_in_blocks(spark, monkeypatch):
    """Many blocks and strips give what one gives; equal products go by id."""
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(90)] + [(90, None), (91, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, S.dense_topk(v.where("vec_id % 5 = 0"), v).collect()))
    want = []
    for i, a in rows[:90:5]:
        best = sorted((-(a[0] * b[0] + a[1] * b[1]), j) for j, b in rows[:90] if j != i)[:4]
        want += [(i, j, -s, n + 1) for n, (s, j) in enumerate(best)]
    for name, size in (("QUERY_BLOCK", 4), ("VECTOR_BLOCK", 20), ("STRIP", 3)):
        monkeypatch.setattr(S, name, size)
    assert whole == sorted(want) == sorted(map(tuple, S.dense_topk(v.where("vec_id % 5 = 0"), v).collect()))


def test_threshold_follows_complexity(spark):
    long, short = "one two three four five six seven eight nine ten. " * 12, "Go on. " * 60
    rows = spark.createDataFrame([(1, long, long), (2, short, long), (3, "Go on.", long)], "pair_id long, a string, b string")
    assert {r.pair_id: r.threshold for r in S.pair_similarity(rows, "pair_id", "a", "b").collect()} == {1: 0.75, 2: 0.7, 3: 0.6}


def test_keyword_scores_lists_every_term(spark):
    text = " ".join(f"term{i}" for i in range(150)) + "."
    rows = S.keyword_scores(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {r.term for r in rows} == {f"term{i}" for i in range(150)} | {f"term{i} term{i + 1}" for i in range(149)}
    assert sorted(r["rank"] for r in rows) == list(range(1, 300))


def test_grammar_changes_by_hand(spark):
    import re

    from inkwell.functions import lexicons as L
    from inkwell.operators import rules as R

    texts = {1: "Im sure we recieve , Then dont RECIEVE it .now im", 2: "nothing here", 3: None, 4: "recieved himself", 5: "occured " * 50 + "end ; X"}
    want = set()
    for i, t in texts.items():
        rules = [(rf"(?i)\b{w}\b", fix) for w, fix, _ in L.GRAMMAR_WORDS] + [(p, r"\1 \2") for p in L.GRAMMAR_PUNCTUATION]
        for k, (p, fix) in enumerate(rules):
            for m in re.finditer(p, t or ""):
                a, b = max(0, m.start() - 50), min(len(t), m.end() + 50)
                want.add((i, k, m.start(), m[0], m.expand(fix), "..." * (a > 0) + t[a:b] + "..." * (b < len(t))))
    got = R.grammar_changes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.rule, r.position, r.original, r.corrected, r.context) for r in got} == want and len(got) == len(want) > 50


def test_keywords_fold_over_all_terms(spark):
    """Words and repeats of chosen pairs may fill more than three places for each chosen term."""
    text = ". ".join("alpha beta alpha alpha beta beta" for _ in range(6)) + ". gamma delta. epsilon zeta."
    got = [r.term for r in S.keywords(spark.createDataFrame([(1, text)], "doc_id long, text string"), top=3).orderBy("place").collect()]
    assert len(got) == 3 and not any(set(a.split()) <= set(b.split()) for i, b in enumerate(got) for a in got[i + 1 :])


def test_entry_without_the_llm_package():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parents[1]
    for path in [*root.glob("inkwell/**/*.py"), *root.glob("tests/*.py")]:
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or n == "corpus_pipeline" for n in names), path
