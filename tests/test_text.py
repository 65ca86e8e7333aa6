"""Small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import bibliography as B
from inkwell.operators import rules as R
from inkwell.operators import similarity as S
from inkwell.operators import structure as X
from inkwell.operators import style as Y


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, column, *texts):
    return [r[0] for r in docs(spark, *texts).orderBy("doc_id").select(column).collect()]


def test_syllables(spark):
    words = ["cat", "table", "make", "readability", "the", "science", "methodology", "used", "rhythm"]
    assert one(spark, T.syllables(F.col("text")), *words) == [1, 2, 1, 5, 1, 1, 5, 2, 1]


def test_readability(spark):
    r = Y.readability(docs(spark, "The model was tested. We measured accuracy carefully.")).first()
    assert (r.sentences, r.words, r.syllables, r.hard) == (2, 8, 18, 3)
    assert (r.flesch, r.grade, r.fog) == (pytest.approx(12.425), pytest.approx(12.52), pytest.approx(16.6))


def test_words_and_syllables_of_whole_texts(spark):
    texts = ["co-operate the whale, tree o'clock 42 a1b rhythm agree", "Ünder_lined éale \u212A \u212Aab \u0130x ½ 漢-a", "a. b.\n c?\t", " . a", "\n", "", None, "\U0001d49c.Al -x- x--y the eeee blue make"]
    syllables = F.transform(F.filter(T.tokens(F.col("text")), lambda w: w.rlike("[A-Za-z0-9]")), T.syllables)
    wanted = F.struct(F.size(syllables).cast("long"), F.aggregate(syllables, F.lit(0), lambda a, x: a + x).cast("long"), F.size(F.filter(syllables, lambda x: x >= 3)).cast("long"), F.regexp_count("text", F.lit("[A-Za-z]")).cast("long"))
    rows = Y.word_stats(docs(spark, *texts).where("text IS NOT NULL").withColumn("w", wanted), ["doc_id"], "text")
    for r in rows.collect():
        assert (r.words, r.syllables, r.hard, r.letters) == tuple(r.w), r.text
    parts = F.size(F.filter(T.sentence_array(F.col("text")), lambda s: F.trim(s) != ""))
    assert one(spark, T.sentence_count(F.col("text")), *texts) == one(spark, F.when(F.col("text").isNotNull(), parts), *texts)


def test_word_stats_cut_no_words(spark):
    rows = Y.readability(docs(spark, "One. Two."))
    assert not any(f in rows._jdf.queryExecution().optimizedPlan().toString() for f in ("regexp_extract_all", "transform(regexp"))


def test_hygiene_patterns_run_where_their_characters_stand(spark):
    from inkwell.functions import lexicons as L

    tells = ["it's important to note", "Its important to note", "it is important to note", "it's worth noting", "its worth noting", "it is worth noting", "this ensures", "This Allows", "in order to", "needless to say", "it should be noted", "as previously mentioned", "moving forward", "essentially", "basically", "fundamentally", "arguably", "comprehensive", "comprehensively",
             *[s + e for s in ("leverag", "utiliz", "delv", "facilitat", "streamlin") for e in ("e", "es", "ed", "ing")]]
    signs = ["<NAME>", "${x y}", "{NAME_1}", "a TBD b", "XXX", "[insert here]", "[INSERT]", "...", "and .... so", "a – b", "a –", "1 – 2", "1 – 2 – b", "<name>", "XXXX", "a...b", "delve", "delver", "plain", "", None]
    rows = R.hygiene(docs(spark, *[f"We {t} x." for t in tells], *signs).withColumn("k", F.struct("doc_id", "text")), "k").selectExpr("k.*", "en_dash", "placeholders", "ai_tells")
    low, ranges = F.lower("text"), F.regexp_replace("text", r"\d\s*–\s*\d", "")
    wanted = F.struct(ranges.rlike(r"\s–|–\s"), F.col("text").rlike(L.PLACEHOLDER), F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(L.AI_TELLS), F.lit(0)))), "|"))
    got = rows.withColumn("w", wanted).collect()
    assert all((r.en_dash, r.placeholders, r.ai_tells) == tuple(r.w) for r in got) and all(r.ai_tells for r in got if r.doc_id < len(tells))
    terms = R.hard_terms(R.hygiene(docs(spark, *signs)))
    assert terms._jdf.queryExecution().optimizedPlan().toString().count("lower(text") == 1


def test_passive_finds_only_the_first(spark):
    got = Y.passive_sentences(docs(spark, "The model was tested. We measured accuracy carefully."))
    assert [r.pos for r in got.collect()] == [0]


def test_corpus_cosine(spark):
    refs = spark.createDataFrame([(0, "alpha beta"), (1, "beta gamma")], "item_id long, text string")
    vocab = S.vocabulary(S.term_counts(refs, ["item_id"], F.col("text")), 2, 100)
    a = S.weigh(docs(spark, "alpha beta beta zeta"), ["doc_id"], F.col("text"), vocab, 1)
    b = S.weigh(refs, ["item_id"], F.col("text"), vocab, 1).withColumnRenamed("w", "v")
    got = {r.item_id: r.s for r in a.join(b, "term").groupBy("item_id").agg(F.sum(F.col("w") * F.col("v")).alias("s")).collect()}
    assert got[0] == pytest.approx(0.942811, abs=1e-6) and got[1] == pytest.approx(0.474331, abs=1e-6)


def test_identical_document_scores_100(spark):
    refs = spark.createDataFrame([(0, "graph data model"), (1, "other words")], "item_id long, text string")
    got = {r.doc_id: r.score for r in S.corpus_scores(docs(spark, "graph data model", "unknown", "", None), refs).collect()}
    assert got == {0: 100.0, 1: 0.0, 2: 0.0, 3: 0.0}


def test_rank_fusion(spark):
    lex = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.8), (1, 2, 0.7)], "q long, i long, lexical double")
    den = spark.createDataFrame([(1, 2, 0.9), (1, 0, 0.8), (1, 1, 0.7)], "q long, i long, dense double")
    got = S.fuse(lex, den, ["q"], "i").orderBy("rank").collect()
    assert [r.i for r in got] == [0, 2, 1]
    assert [round(r.fused, 6) for r in got] == [0.033060, 0.032796, 0.032522]


def test_noisy_or_and_perplexity(spark):
    row = spark.range(1).select(Y.noisy_or([(F.lit(50.0), 0.7)]).alias("a"), Y.noisy_or([(F.lit(90.0), 0.9), (F.lit(20.0), 0.5)]).alias("b"), *[Y.perplexity_score(F.lit(float(p))).alias(f"p{p}") for p in (5, 35, 60)]).first()
    assert round(row.a, 1) == 38.4 and round(row.b, 1) == 88.7
    assert (row.p5, row.p35, row.p60) == (100.0, 50.0, 0.0)


def test_perplexity_score_rounds_halves_up(spark):
    # halves of the last place whose quotients lie one bit below them
    rows = spark.createDataFrame([(32.525, 55.0), (32.775, 54.5), (33.025, 54.0), (35.0249, 50.0), (9.0, 100.0), (61.0, 0.0)], "p double, expected double")
    assert rows.where(Y.perplexity_score(F.col("p")) != F.col("expected")).count() == 0


def test_longer_phrase_suppresses_shorter(spark):
    text = "we delve into x. we delve , y " + "word " * 30 + "."
    assert Y.machine_style(docs(spark, text)).first().hits == 1


def test_sections_and_merging(spark):
    got = {r.name: r.body for r in T.sections(docs(spark, "Intro\na\nMethods\nb\nMethodology\nc")).collect()}
    assert got == {"Introduction": "a", "Methodology": "b\nc"}


def test_order_of_sections(spark):
    text = "Results\nx\nMethodology\ny"
    assert X.structure_totals(X.structure_check(docs(spark, text))).first().order_ok is False


def test_paragraph_fallback(spark):
    got = T.paragraphs(docs(spark, "one two three four five\nsix seven eight nine ten")).collect()
    assert len(got) == 2


def test_reference_entries(spark):
    got = T.reference_entries(docs(spark, "[1] A b c d\n2. e f")).collect()
    assert [r.entry for r in got] == ["A b c d"]


def test_best_record_prefers_doi(spark):
    rows = [(1, "A b", [("x", "y")] * 5, "", "", "", "", ""), (2, "a B", [("x", "y")], "", "", "", "10.1/x", "")]
    got = B.best_records(spark.createDataFrame(rows, B.REFERENCE)).collect()
    assert [(r.id, r.place) for r in got] == [(2, 1)]


def test_title_overlap_is_possible_match(spark):
    e = spark.createDataFrame([(1, "alpha beta gamma delta more words here longer")], "entry_id long, entry string")
    c = spark.createDataFrame([(9, "alpha beta gamma delta epsilon", [], "", "", "", "", "")], B.REFERENCE)
    r = B.verdicts(e, c).first()
    assert r.verdict == "Possible match" and round(r.confidence, 6) == 0.615385


def test_formats(spark):
    ref = [(1, "T", [("Ada Mae", "L")], "2020", "J", "", "10.1/x", "")]
    r = spark.createDataFrame(ref, B.REFERENCE).select(*[B.formatted(s).alias(s) for s in ("APA", "IEEE", "MLA")]).first()
    assert r.APA == "L, A. M. (2020). T. J. https://doi.org/10.1/x"
    assert r.IEEE == 'A. M. L, "T," J, 2020. doi: 10.1/x.'
    assert r.MLA == 'L, Ada Mae. "T." J, 2020. https://doi.org/10.1/x.'


def test_rubric(spark):
    item = "p long, index int, score double, weight double, severity string, unavailable boolean"
    rows = [(1, 0, 80.0, 0.25, "", False), (1, 1, 40.0, 0.75, "", False), (1, 2, 0.0, 1.0, "", True), (2, 0, 80.0, 0.0, "", False), (2, 1, 40.0, 0.0, "", False)]
    got = {r.p: (r.total, r.scored, r.skipped) for r in R.rubric_total(spark.createDataFrame(rows, item), ["p"]).collect()}
    assert got == {1: (50.0, 2, 1), 2: (60.0, 2, 0)}


def test_plan_order(spark):
    item = "p long, index int, score double, weight double, severity string, unavailable boolean"
    rows = [(1, 0, 70.0, 1.0, "Major", False), (1, 1, 50.0, 1.0, "", False), (1, 2, 90.0, 1.0, "None", False)]
    got = R.revision_plan(spark.createDataFrame(rows, item), ["p"]).orderBy("place").collect()
    assert [r["index"] for r in got] == [0, 1]


def test_lone_i_changes_nothing(spark):
    r = R.grammar_counts(docs(spark, "i think")).first()
    assert (r.grammar, r.spelling, r.punctuation) == (0, 0, 0)


def test_corrected_text(spark):
    assert one(spark, R.grammar_corrected(F.col("text")), "dont recieve ,Now") == ["don't receive, Now"]


def test_variants_need_three_uses(spark):
    assert X.term_variants(docs(spark, "dataset dataset data-set")).first().total == 3
    assert X.term_variants(docs(spark, "dataset data-set")).count() == 0


def test_repetition_skips_adjoining(spark):
    s = "The quick brown foxes jump over lazy sleeping dogs."
    other = "Completely different statement about markets, rivers and several distant mountains."
    assert S.repeated_sentences(docs(spark, f"{s} {s}")).count() == 0
    assert S.repeated_sentences(docs(spark, f"{s} {other} {s}")).first().similarity == 1.0


def test_unicode_words(spark):
    assert one(spark, T.analysed(F.col("text"), stop=False), "Über große Wörter") == [["über", "große", "wörter"]]


def test_chunks_cover_all_sentences(spark):
    sents = [f"Sentence number {i} has exactly seven words." for i in range(50)]
    got = [r.chunk for r in T.chunks(docs(spark, " ".join(sents))).orderBy("chunk_id").collect()]
    assert all(any(s in c for c in got) for s in sents)
    assert all(len(c.split()) >= 130 for c in got[:-1])


def test_trimming(spark):
    assert one(spark, T.trim_to_words(F.col("text"), 5), "One two three. Four five six.", "a b c d e f g", "short one") == ["One two three.", "a b c d e", "short one"]


def test_code_spans_keep_their_characters(spark):
    assert one(spark, T.typographic(F.col("text")), "“a” — b `“c”` 1–2…") == ['"a", b `“c”` 1-2...']


def test_empty_table(spark):
    empty = docs(spark, "x").where("false")
    for f in (Y.readability, Y.tone_rates, Y.machine_style, S.repeated_sentences, S.cohesion, X.acronyms, R.hygiene):
        assert f(empty).count() == 0
