"""The library's queries, each with SQL that states the same result for another engine."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import lexicons as L
from inkwell.functions import text as T
from inkwell.functions import typology as K
from inkwell.functions.typology import PARAPHRASES
from inkwell.operators import bibliography as B
from inkwell.operators import kneser as Q
from inkwell.operators import lemmas as M
from inkwell.operators import packed as G
from inkwell.operators import punkt as U
from inkwell.operators import ranking as N
from inkwell.operators import rules as R
from inkwell.operators import similarity as S
from inkwell.operators import structure as X
from inkwell.operators import style as Y
from inkwell.operators import typing as V
from inkwell.plans import samples as P
from inkwell.sources.readers import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
TOKEN = rf"{W}+(?:[-''’.]{W}+)*"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_papers(spark, table(spark, sf_dir, "documents"))


def listed(words: list[str]) -> str:
    return "[" + ", ".join(P.literal(w) for w in words) + "]"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def n_found(text: str, pattern: str, flags: str = "") -> str:
    """Number of matches; flags go inside the pattern."""
    return f"len(regexp_extract_all({text}, {quoted(f'(?{flags})' + pattern if flags else pattern)}))"


def sent_cte(source: str = "docs", key: str = "doc_id", text: str = "text", name: str = "sents") -> str:
    return rf"{name} AS (SELECT * FROM (SELECT {key}, generate_subscripts(a, 1) - 1 AS pos, trim(unnest(a)) AS sent FROM (SELECT {key}, string_split(regexp_replace({text}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS a FROM {source})) WHERE sent <> '')"


def words_sql(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '\S+'))"


def norm_sql(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


def syl_sql(w: str) -> str:
    x = f"regexp_replace(lower({w}), '[^a-z]', '', 'g')"
    return f"CASE WHEN length({x}) = 0 THEN 0 WHEN length({x}) <= 3 THEN 1 ELSE greatest(len(regexp_extract_all({x}, '[aeiouy]+')) - CASE WHEN {x} LIKE '%e' AND {x} NOT LIKE '%le' THEN 1 ELSE 0 END, 1) END"


def heading_sql(line: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace(trim({line}), '^[#>*\-•\d.)(\s:]+', ''), '[*_#:.\s]+$', '')))"


# text

@query(rf"""SELECT doc_id, md5({norm_sql('text')}) AS norm_md5, length({norm_sql('text')}) AS norm_chars, {words_sql('text')} AS n_words, length(text) AS n_chars, CASE WHEN length(text) > 90 THEN left(text, 90) || '…' ELSE text END AS preview,
md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS key_md5 FROM documents""")
def text_normal_forms(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise(t)).alias("norm_md5"), F.length(T.normalise(t)).cast("long").alias("norm_chars"), T.words(t).cast("long").alias("n_words"), F.length(t).cast("long").alias("n_chars"), T.preview(t).alias("preview"), F.md5(T.title_key(t)).alias("key_md5"))


CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s.,;:!?\-()\[\]]', '', 'g'), 'Page \d+', '', 'g'), '^\d+\s*', ''))"


@query(f"SELECT doc_id, md5({CLEAN}) AS clean_md5, length({CLEAN}) AS clean_chars FROM documents")
def clean_papers(spark, sf_dir):
    c = T.clean_paper(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("long").alias("clean_chars"))


def _nested_replace(text: str) -> str:
    for a, b in PARAPHRASES:
        text = f"replace({text}, {P.literal(a)}, {P.literal(b)})"
    return text


@query(f"SELECT doc_id, md5({_nested_replace('text')}) AS paraphrase_md5 FROM documents")
def dictionary_paraphrase(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.paraphrase(F.col("text"), PARAPHRASES)).alias("paraphrase_md5"))


@query(rf"""WITH {P.DOCS}, {sent_cte()} SELECT doc_id, pos, length(sent) AS n_chars, {words_sql('sent')} AS n_words, length({norm_sql('sent')}) > 20 AND length(sent) > 10 AS comparable FROM sents""")
def sentence_table(spark, sf_dir):
    s = T.sentences(papers(spark, sf_dir))
    n = F.length(T.normalise(F.col("sent")))
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("sent").cast("long").alias("n_chars"), T.words(F.col("sent")).cast("long").alias("n_words"), ((n > 20) & (F.length("sent") > 10)).alias("comparable"))


_CORE = lambda t: rf"""regexp_replace(regexp_replace(lower({t}), '["''’”»)\]}}]+$', ''), '^[^\p{{L}}\p{{N}}]+', '')"""
_TYPE = lambda c: rf"CASE WHEN regexp_matches(regexp_replace({c}, '\.$', ''), '^[0-9]+([.,][0-9]+)*$') THEN '##' ELSE regexp_replace({c}, '\.$', '') END"
_LEAN = lambda n, ab, p: f"({ab}) * ln({p}) + (({n}) - ({ab})) * ln(1 - ({p}))"
_INSIDE_01 = lambda p, x: f"CASE WHEN {p} > 0 AND {p} < 1 THEN {x} ELSE 0 END"
_MARK = lambda t: rf"""regexp_extract(regexp_replace({t}, '["''’”»)\]}}]+$', ''), '([.!?])$', 1)"""


def together_sql(a: str, b: str, ab: str, n: str) -> str:
    p, p1, p2, rest = f"{b}::DOUBLE / {n}", f"{ab}::DOUBLE / {a}", f"({b} - {ab})::DOUBLE / ({n} - {a})", f"({n} - {a} - {b} + {ab})"
    low = lambda q: f"({b} - {ab}) * ln({q}) + {rest} * ln(1 - {q})"
    return f"round(-2 * ({_LEAN(a, ab, p)} + {low(p)} - {_INSIDE_01(p1, _LEAN(a, ab, p1))} - {_INSIDE_01(p2, low(p2))}), 6)"


#: The boundary model over ``docs``, fitted on all of it, and ``pk``: each token with whether a sentence ends at it.
PUNKT = rf"""pt0 AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS tok, unnest(list_append(a[2:], NULL)) AS nxt FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS a FROM docs) WHERE len(a) > 0),
pt1 AS (SELECT *, {_CORE('tok')} AS core, {_CORE('nxt')} AS ncore, regexp_replace(nxt, '^[^\p{{L}}\p{{N}}]+', '') AS bare, {_MARK('tok')} AS ends FROM pt0),
pt AS (SELECT doc_id, pos, tok, ends, {_TYPE('core')} AS typ, core LIKE '%.' AS per, core LIKE '%..' AS dots, {_TYPE('ncore')} AS n_typ, regexp_matches(bare, '^\p{{Lu}}') AS n_cap, regexp_matches(bare, '^\p{{Ll}}') AS n_low, regexp_matches(bare, '^[\p{{L}}\p{{N}}]') AS n_word FROM pt1),
pc AS (SELECT typ, count_if(per) AS per, count_if(NOT per) AS plain FROM pt GROUP BY typ), pn AS (SELECT sum(per + plain)::BIGINT AS n, sum(per)::BIGINT AS b FROM pc),
ps AS (SELECT typ, per, plain, n, b, length(typ) - length(replace(typ, '.', '')) AS inn FROM pc, pn WHERE per > 0 AND regexp_matches(typ, '\p{{L}}') AND b < n),
pa AS (SELECT typ FROM ps WHERE round(-2 * ({_LEAN('per + plain', 'per', 'b::DOUBLE / n')} - ({_LEAN('per + plain', 'per', str(U.SURE))})) * exp(-(length(typ) - inn)::DOUBLE) * (inn + 1) * pow((length(typ) - inn)::DOUBLE, -plain::DOUBLE), 6) >= {U.ABBREVIATION}),
pf AS (SELECT pt.*, pa.typ IS NOT NULL AS abbr, ends IN ('!', '?') OR (per AND pa.typ IS NULL AND NOT dots) AS sure, typ = '##' OR regexp_matches(typ, '^\p{{L}}$') AS odd, regexp_matches(typ, '^\p{{L}}$') AS ini FROM pt LEFT JOIN pa USING (typ)),
po AS (SELECT n_typ, bool_or(n_low) AS low, bool_or(n_cap) AS cap, bool_or(n_cap AND ends = '' AND NOT sure) AS mid_cap, bool_or(n_low AND sure) AS low_after, count_if(sure) AS aft, count_if(sure AND NOT odd) AS starts FROM pf WHERE n_typ IS NOT NULL GROUP BY n_typ),
pe AS (SELECT sum(aft)::BIGINT AS e FROM po),
pst AS (SELECT n_typ FROM (SELECT n_typ, per + plain AS uses, starts, n, e FROM po JOIN pc ON pc.typ = n_typ, pn, pe WHERE starts > 0 AND regexp_matches(n_typ, '\p{{L}}') AND per + plain >= starts AND e > 0 AND e < n) WHERE {together_sql('e', 'uses', 'starts', 'n')} >= {U.STARTER} AND n * starts > uses * e),
pco AS (SELECT typ, n_typ FROM (SELECT g.typ, g.n_typ, both_n, x.per + x.plain AS a, y.per + y.plain AS b2, n FROM (SELECT typ, n_typ, count(*) AS both_n FROM pf WHERE per AND sure AND odd AND n_typ <> '' GROUP BY typ, n_typ HAVING count(*) > 1) g JOIN pc x ON x.typ = g.typ JOIN pc y ON y.typ = g.n_typ, pn) WHERE both_n <= least(a, b2) AND {together_sql('a', 'b2', 'both_n', 'n')} >= {U.COLLOCATION} AND n * both_n > a * b2),
pd AS (SELECT pf.*, coalesce(n_cap, false) AS nc, coalesce(n_low, false) AS nl, coalesce(low, false) AS lo, coalesce(n_cap AND low AND NOT mid_cap, false) AS begins, NOT coalesce(n_word, false) OR coalesce(n_low AND (cap OR NOT low_after), false) AS goes_on, pst.n_typ IS NOT NULL AS starter, pco.typ IS NOT NULL AS tied FROM pf LEFT JOIN po ON po.n_typ = pf.n_typ AND ends = '.' LEFT JOIN pst ON pst.n_typ = pf.n_typ AND ends = '.' LEFT JOIN pco ON pco.typ = pf.typ AND pco.n_typ = pf.n_typ AND ends = '.'),
pk AS (SELECT doc_id, pos, tok, CASE WHEN n_typ IS NULL OR ends = '' THEN false WHEN ends <> '.' THEN true WHEN tied THEN false WHEN (abbr OR dots) AND NOT ini THEN begins OR (nc AND starter) WHEN odd THEN begins OR (NOT goes_on AND NOT (ini AND nc AND NOT lo)) ELSE true END AS brk FROM pd)"""


@query(rf"""WITH {P.DOCS}, {PUNKT} SELECT doc_id, sno AS pos, count(*) AS n_words, md5(string_agg(tok, ' ' ORDER BY pk2.pos)) AS sent_md5 FROM (SELECT *, coalesce(sum(brk::BIGINT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sno FROM pk) pk2 GROUP BY doc_id, sno""")
def sentence_punkt(spark, sf_dir):
    docs = papers(spark, sf_dir)
    return U.sentences(docs, U.fit(docs)).select("doc_id", "pos", "n_words", F.md5("sent").alias("sent_md5"))


@query(r"""SELECT page_id, length(t) AS n_chars, len(regexp_extract_all(t, '\S+')) AS n_words, md5(t) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)""")
def html_text_extract(spark, sf_dir):
    from inkwell.sources.readers import html_text

    t = html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), T.words(t).cast("long").alias("n_words"), F.md5(t).alias("text_md5"))


# style

_STATS = rf"""list_filter(regexp_extract_all(text, '{TOKEN}'), lambda w: regexp_matches(w, '[A-Za-z0-9]')) AS ws"""


@query(rf"""WITH {P.DOCS}, a AS (SELECT doc_id, text, list_transform({_STATS.removesuffix(' AS ws')}, lambda w: {syl_sql('w')}) AS syl, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS sentences FROM docs),
b AS (SELECT doc_id, sentences, len(syl) AS words, CAST(list_sum(syl) AS BIGINT) AS syllables, len(list_filter(syl, lambda x: x >= 3)) AS hard, len(regexp_extract_all(text, '[A-Za-z]')) AS letters FROM a WHERE len(syl) > 0 AND sentences > 0),
c AS (SELECT *, 206.835::DOUBLE - 1.015::DOUBLE * words / sentences - 84.6::DOUBLE * syllables / words AS f FROM b)
SELECT doc_id, sentences, words, syllables, hard, letters, round(f, 6) AS flesch, round(0.39::DOUBLE * words / sentences + 11.8::DOUBLE * syllables / words - 15.59::DOUBLE, 6) AS grade, round(0.4::DOUBLE * (words::DOUBLE / sentences + 100::DOUBLE * hard / words), 6) AS fog, round(words::DOUBLE / 200, 6) AS read_minutes, round(words::DOUBLE / 130, 6) AS speak_minutes,
CASE WHEN f >= 90 THEN 'very easy' WHEN f >= 80 THEN 'easy' WHEN f >= 70 THEN 'fairly easy' WHEN f >= 60 THEN 'standard' WHEN f >= 50 THEN 'fairly difficult' WHEN f >= 30 THEN 'difficult' ELSE 'very difficult' END AS band FROM c""")
def readability_metrics(spark, sf_dir):
    return Y.readability(papers(spark, sf_dir))


@query(rf"""WITH {P.DOCS}, {sent_cte()}, a AS (SELECT doc_id, pos, list_transform(list_filter(regexp_extract_all(sent, '{TOKEN}'), lambda w: regexp_matches(w, '[A-Za-z0-9]')), lambda w: {syl_sql('w')}) AS syl FROM sents),
b AS (SELECT doc_id, pos, len(syl) AS words, CAST(list_sum(syl) AS BIGINT) AS syllables FROM a WHERE len(syl) > 0)
SELECT *, CASE WHEN words > 30 OR syllables::DOUBLE / words > 1.9 THEN 'hard' WHEN words > 22 OR syllables::DOUBLE / words > 1.6 THEN 'medium' ELSE 'easy' END AS level FROM b""")
def sentence_difficulty(spark, sf_dir):
    return Y.sentence_difficulty(papers(spark, sf_dir))


_FIRST = "row_number() OVER (PARTITION BY doc_id ORDER BY pos)"
_PASSIVE = rf"(?i)(?:^|{NW})(?:{'|'.join(L.BE_FORMS)})\s+(?:[a-z]+ly\s+)?(?:[a-z]+ed|{'|'.join(L.IRREGULAR_PARTICIPLES)})(?:$|{NW})"


@query(f"WITH {P.DOCS}, {sent_cte()} SELECT doc_id, pos, sent, {_FIRST} AS rank FROM sents WHERE regexp_matches(sent, {quoted(_PASSIVE)}) QUALIFY rank <= 10")
def passive_sentences(spark, sf_dir):
    return Y.passive_sentences(papers(spark, sf_dir))


@query(f"WITH {P.DOCS}, {sent_cte()}, a AS (SELECT doc_id, pos, {words_sql('sent')} AS n_words FROM sents) SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_words DESC, pos) AS rank FROM a WHERE n_words > 25 QUALIFY rank <= 10")
def long_sentences(spark, sf_dir):
    return Y.long_sentences(papers(spark, sf_dir))


def doubled(text: str) -> str:
    """Padded text with each non-letter twice, so that neighbouring matches don't share a boundary."""
    return rf"regexp_replace(' ' || lower({text}) || ' ', '([^a-z])', '\1\1', 'g')"


def bounded(phrase: str) -> str:
    open_ended = phrase.endswith(" ")
    body = re.sub(r"([^a-z])", r"\1\1", phrase.rstrip(" "))
    return "[^a-z]" + re.escape(body).replace("\\ ", " ") + (" " if open_ended else "[^a-z]")


_TONE = " UNION ALL ".join(f"SELECT doc_id, n, {P.literal(k)} AS category, {' + '.join(n_found('d', bounded(p)) for p in ps)} AS hits FROM a" for k, ps in L.TONE.items())


@query(f"WITH {P.DOCS}, a AS (SELECT doc_id, {words_sql('text')} AS n, {doubled('text')} AS d FROM docs WHERE {words_sql('text')} >= 20), b AS ({_TONE}) SELECT doc_id, category, hits, round(hits * 1000.0::DOUBLE / n, 6) AS per_1000 FROM b")
def tone_lexicon_rates(spark, sf_dir):
    return Y.tone_rates(papers(spark, sf_dir))


def _hits(k: str) -> str:
    return "(" + " + ".join(n_found("d", bounded(p)) for p in L.TONE[k]) + ")"


@query(f"WITH {P.DOCS}, {sent_cte()}, a AS (SELECT doc_id, pos, {doubled('sent')} AS d FROM sents), b AS (SELECT doc_id, pos, 'overclaim' AS kind FROM a WHERE {_hits('Overclaiming')} >= 1 UNION ALL SELECT doc_id, pos, 'overhedged' FROM a WHERE {_hits('Hedging')} >= 2) SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS rank FROM b QUALIFY rank <= 8")
def tone_examples(spark, sf_dir):
    return Y.tone_examples(papers(spark, sf_dir))


def _phrase(p: str) -> str:
    one = lambda e: f"(length(t) - length(replace(t, {P.literal(' ' + p + e)}, ''))) // {len(p) + 2}"
    return "(" + " + ".join(one(e) for e in (" ", ",", ".")) + ")"


_LONGER = {p: [q for q in L.AI_PHRASES if q != p and p in q] for p in L.AI_PHRASES}
_AI_HITS = " + ".join(f"(CASE WHEN {' + '.join(_phrase(q) for q in _LONGER[p])} > 0 THEN 0 ELSE {_phrase(p)} END)" if _LONGER[p] else _phrase(p) for p in L.AI_PHRASES)


@query(rf"""WITH {P.DOCS}, a AS (SELECT doc_id, ' ' || lower(text) || ' ' AS t, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {words_sql('s')}), lambda n: n > 0) AS lens,
list_filter(regexp_extract_all(lower(text), '{TOKEN}'), lambda w: regexp_matches(w, '[a-z]')) AS ws FROM docs),
b AS (SELECT doc_id, len(lens) AS sentences, len(ws) AS words, len(list_distinct(ws)) AS distinct_words, {_AI_HITS} AS hits, list_avg(lens) AS m, list_avg(list_transform(lens, lambda x: x * x)) AS sq FROM a WHERE len(ws) >= 25 AND len(lens) >= 2),
c AS (SELECT *, sqrt(greatest(sq - m * m, 0)) / m AS cv0 FROM b),
d AS (SELECT *, 0.45::DOUBLE * least(greatest(1 - cv0 / 0.6::DOUBLE, 0), 1) + 0.10::DOUBLE * least(greatest((0.6::DOUBLE - distinct_words::DOUBLE / words) / 0.4::DOUBLE, 0), 1) + 0.45::DOUBLE * least(greatest(hits::DOUBLE / sentences / 0.8::DOUBLE, 0), 1) AS h FROM c),
e AS (SELECT *, round(100 * (1 - pow(1 - least(h, 0.999999), 0.7)), 6) AS score FROM d)
SELECT doc_id, sentences, words, distinct_words, hits, round(cv0, 6) AS cv, round(100 * h, 6) AS heuristic, score, CASE WHEN score >= 65 THEN 'likely machine' WHEN score >= 35 THEN 'mixed' ELSE 'likely human' END AS verdict FROM e""")
def ai_style_signals(spark, sf_dir):
    return Y.machine_style(papers(spark, sf_dir))


_MARKERS = lambda t: "(" + " + ".join(n_found(t, p) for p in L.CITATIONS) + ")"


@query(f"WITH {P.DOCS} SELECT doc_id, {_MARKERS('text')} AS markers, {words_sql('text')} AS n_words, round({_MARKERS('text')} * 1000.0::DOUBLE / greatest({words_sql('text')}, 1), 6) AS per_1000 FROM docs")
def citation_density(spark, sf_dir):
    return Y.citation_density(papers(spark, sf_dir))


@query(f"WITH {P.DOCS}, {sent_cte()} SELECT doc_id, pos, sent, {_FIRST} AS rank FROM sents WHERE (regexp_matches(sent, {quoted('(?i)' + L.STRONG_CLAIM)}) OR regexp_matches(sent, {quoted(L.NUMBER_CLAIM)})) AND {_MARKERS('sent')} = 0 QUALIFY rank <= 25")
def uncited_claims(spark, sf_dir):
    return Y.uncited_claims(papers(spark, sf_dir))


@query(f"WITH {P.DOCS}, {sent_cte()} SELECT doc_id, pos, sent, {_FIRST} AS rank FROM sents WHERE regexp_matches(sent, {quoted('(?i)' + L.CONTRIBUTION)}) QUALIFY rank <= 10")
def contribution_statements(spark, sf_dir):
    return Y.contributions(papers(spark, sf_dir))


# similarity

STOP = listed(L.STOP_WORDS)


def grams_cte(name: str, source: str, keys: str, text: str, n_max: int = 1, stop: bool = True) -> str:
    """``name``: (keys, term, tf)."""
    ws = f"regexp_extract_all(lower({text}), '{W}{{2,}}')"
    ws = f"list_filter({ws}, lambda w: NOT list_contains({STOP}, w))" if stop else ws
    parts = ["SELECT {k}, unnest(ws) AS term FROM {n}_w", "SELECT {k}, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM {n}_w"][:n_max]
    union = " UNION ALL ".join(p.format(k=keys, n=name) for p in parts)
    return f"{name}_w AS (SELECT {keys}, {ws} AS ws FROM {source}), {name} AS (SELECT {keys}, term, count(*) AS tf FROM ({union}) GROUP BY ALL)"


def scoped_cte(name: str, source: str, keys: str, text: str, n_max: int = 1, stop: bool = True) -> str:
    """``name``: unit vectors (keys, term, w) fitted for each doc_id."""
    return f"""{grams_cte(name + '_c', source, keys, text, n_max, stop)}, {name}_d AS (SELECT doc_id, term, count(*) AS df FROM {name}_c GROUP BY ALL), {name}_n AS (SELECT doc_id, count(*) AS n FROM {source} GROUP BY ALL),
{name}_r AS (SELECT {', '.join('c.' + k for k in keys.split(', '))}, c.term, tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM {name}_c c JOIN {name}_d d ON c.doc_id = d.doc_id AND c.term = d.term JOIN {name}_n n ON c.doc_id = n.doc_id),
{name} AS (SELECT {keys}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {keys})) AS w FROM {name}_r)"""


def fitted_cte(max_features: int = 5000) -> str:
    return f"{grams_cte('rc', 'benchmark', 'item_id', 'text', 2)}, vocab AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM rc GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {max_features})"


def weigh_cte(name: str, source: str, keys: str, text: str) -> str:
    return f"{grams_cte(name + '_c', source, keys, text, 2)}, {name}_r AS (SELECT {keys}, term, tf * idf AS w FROM {name}_c JOIN vocab USING (term)), {name} AS (SELECT {keys}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {keys})) AS w FROM {name}_r)"


@query(f"""WITH {fitted_cte()}, {weigh_cte('a', 'documents', 'doc_id', 'text')}, {weigh_cte('b', 'benchmark', 'item_id', 'text')},
dots AS (SELECT doc_id, item_id, sum(a.w * b.w) AS s FROM a JOIN b USING (term) GROUP BY ALL), best AS (SELECT doc_id, max(s) AS s FROM dots GROUP BY ALL),
sc AS (SELECT doc_id, round(coalesce(s, 0) * 100, 6) AS score FROM documents LEFT JOIN best USING (doc_id))
SELECT doc_id, score, score > 70 AS flagged, CASE WHEN score < 30 THEN 'low' WHEN score < 60 THEN 'moderate' WHEN score <= 70 THEN 'high' ELSE 'very high' END AS band FROM sc""")
def plagiarism_doc_score(spark, sf_dir):
    return S.corpus_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _clean_cte(name: str, source: str, key: str) -> str:
    return f"{sent_cte(source, key, 'text', name + '_s')}, {name} AS (SELECT {key}, pos, {norm_sql('sent')} AS proc FROM {name}_s WHERE length(sent) > 10 AND length({norm_sql('sent')}) > 20)"


@query(f"""WITH {fitted_cte()}, {_clean_cte('dp', 'documents', 'doc_id')}, {_clean_cte('rp0', 'benchmark', 'item_id')}, rp AS (SELECT item_id, pos AS ref_pos, proc FROM rp0), {weigh_cte('a', 'dp', 'doc_id, pos', 'proc')}, {weigh_cte('b', 'rp', 'item_id, ref_pos', 'proc')},
dots AS (SELECT doc_id, pos, item_id, ref_pos, round(sum(a.w * b.w), 6) AS similarity FROM a JOIN b USING (term) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, pos, item_id, ref_pos) AS rank FROM dots WHERE similarity > 0.7 QUALIFY rank <= 5""")
def plagiarism_sentence_pairs(spark, sf_dir):
    return S.sentence_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"""WITH {P.DOCS}, {sent_cte()}, u AS (SELECT doc_id, sent, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM sents WHERE {words_sql('sent')} >= 8), {scoped_cte('w', 'u', 'doc_id, i', 'sent')},
dots AS (SELECT a.doc_id, a.i, b.i AS j, round(sum(a.w * b.w), 6) AS similarity FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.term = b.term AND b.i - a.i > 1 GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, i, j) AS rank FROM dots WHERE similarity >= 0.8 QUALIFY rank <= 25""")
def self_repetition_pairs(spark, sf_dir):
    return S.repeated_sentences(papers(spark, sf_dir))


_LINKED = " OR ".join(f"contains(h, {P.literal(' ' + c + ' ')})" for c in L.CONNECTORS)
_PARA = lambda split: rf"list_filter(list_transform({split}, lambda p: trim(p)), lambda p: {words_sql('p')} >= 5)"


@query(rf"""WITH {P.DOCS}, pa AS (SELECT doc_id, {_PARA("string_split_regex(trim(text), '\\n\\s*\\n')".replace(chr(92) * 2, chr(92)))} AS x, {_PARA("string_split(trim(text), chr(10))")} AS y FROM docs), pb AS (SELECT doc_id, CASE WHEN len(x) < 2 THEN y ELSE x END AS z FROM pa),
p AS (SELECT doc_id, generate_subscripts(z, 1) - 1 AS pos, unnest(z) AS para FROM pb), {scoped_cte('w', 'p', 'doc_id, pos', 'para')},
dots AS (SELECT a.doc_id, a.pos, sum(a.w * b.w) AS s FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.term = b.term AND b.pos = a.pos + 1 GROUP BY ALL),
hd AS (SELECT doc_id, pos, ' ' || array_to_string(list_transform(string_split_regex(trim(para), '\s+')[1:6], lambda v: lower(regexp_replace(v, '^[.,;:]+|[.,;:]+$', '', 'g'))), ' ') || ' ' AS h FROM p),
e AS (SELECT doc_id, pos, lead({_LINKED}) OVER (PARTITION BY doc_id ORDER BY pos) AS linked, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM hd),
f AS (SELECT e.doc_id, e.pos, linked, CAST(round(coalesce(s, 0) * 1000000) AS BIGINT) AS q FROM e LEFT JOIN dots USING (doc_id, pos) WHERE nx IS NOT NULL),
st AS (SELECT doc_id, count(*) AS n, CAST(sum(q) AS HUGEINT) AS total, CAST(sum(CAST(q AS HUGEINT) * q) AS HUGEINT) AS squares FROM f GROUP BY doc_id),
g AS (SELECT f.doc_id, pos, linked, round(q / 1e6::DOUBLE, 6) AS similarity, round(greatest(0.05::DOUBLE, (total::DOUBLE - 0.75::DOUBLE * sqrt((n * squares - total * total)::DOUBLE)) / (n::DOUBLE * 1e6::DOUBLE)), 6) AS threshold FROM f JOIN st ON st.doc_id = f.doc_id)
SELECT doc_id, pos, similarity, threshold, linked, similarity < threshold AND NOT linked AS weak FROM g""")
def paragraph_cohesion(spark, sf_dir):
    return S.cohesion(papers(spark, sf_dir))


@query(f"""WITH {P.DOCS}, {sent_cte()}, {scoped_cte('w', 'sents', 'doc_id, pos', 'sent', stop=False)}, sc AS (SELECT doc_id, pos, sum(w) AS s FROM w GROUP BY ALL),
r AS (SELECT doc_id, pos, round(coalesce(s, 0), 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(coalesce(s, 0), 6) DESC, pos) AS rk FROM sents LEFT JOIN sc USING (doc_id, pos) QUALIFY rk <= 3)
SELECT doc_id, pos, score, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM r""")
def extractive_summary(spark, sf_dir):
    return S.summary_sentences(papers(spark, sf_dir))


@query(f"""WITH {P.DOCS}, {sent_cte()}, {scoped_cte('w', 'sents', 'doc_id, pos', 'sent', 2)}, sc AS (SELECT doc_id, term, round(sum(w), 6) AS score FROM w GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, len(string_split(term, ' ')) DESC, term) AS rank FROM sc""")
def keyword_scores(spark, sf_dir):
    return S.keyword_scores(papers(spark, sf_dir))


_INSIDE = "len(list_filter(string_split(t, ' '), lambda v: NOT list_contains(string_split(k, ' '), v))) = 0"


@query(f"""WITH {P.DOCS}, {sent_cte()}, {scoped_cte('w', 'sents', 'doc_id, pos', 'sent', 2)}, sc AS (SELECT doc_id, term, round(sum(w), 6) AS score FROM w GROUP BY ALL),
ts AS (SELECT doc_id, list(term ORDER BY score DESC, len(string_split(term, ' ')) DESC, term) AS terms FROM sc GROUP BY doc_id),
ch AS (SELECT doc_id, list_reduce(terms, lambda acc, t: CASE WHEN len(acc) >= 8 OR len(list_filter(acc, lambda k: {_INSIDE})) > 0 THEN acc ELSE list_append(acc, t) END, []::VARCHAR[]) AS chosen FROM ts)
SELECT doc_id, generate_subscripts(chosen, 1) - 1 AS place, unnest(chosen) AS term FROM ch""")
def top_keywords(spark, sf_dir):
    return S.keywords(papers(spark, sf_dir))


def complexity_sql(text: str) -> str:
    tokens = f"regexp_extract_all({text}, '{TOKEN}')"
    sents = rf"len(list_filter(string_split(regexp_replace({text}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''))"
    technical = f"len(list_filter({tokens}, lambda w: list_contains({listed(S.TECHNICAL)}, w)))"
    return f"CASE WHEN len({tokens}) > 0 THEN least(0.3::DOUBLE * len({tokens}) / {sents} + 0.4::DOUBLE * len(list_distinct({tokens})) / len({tokens}) + 0.3::DOUBLE * {technical} / len({tokens}), 1.0::DOUBLE) ELSE 0 END"


_LENS = lambda c: rf"list_transform(list_filter(string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''), lambda s: {words_sql('s')})"
_TERMS = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '{W}{{2,}}'), lambda w: NOT list_contains({STOP}, w)))"


@query(f"""WITH prs AS (SELECT * FROM {P.values(P.PAIRS, 'pair_id, a, b')} UNION ALL SELECT doc_id, documents.text, benchmark.text FROM documents JOIN benchmark ON item_id = doc_id % 40), u AS (SELECT pair_id AS doc_id, 0 AS side, a AS text FROM prs UNION ALL SELECT pair_id, 1, b FROM prs), {scoped_cte('w', 'u', 'doc_id, side', 'text', 2)},
dot AS (SELECT x.doc_id AS pair_id, sum(x.w * y.w) AS cosine FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.term = y.term AND x.side = 0 AND y.side = 1 GROUP BY ALL),
m AS (SELECT pair_id, {words_sql('a')} AS n, {complexity_sql('a')} AS cx, {_LENS('a')} AS la, {_LENS('b')} AS lb, {_TERMS('a')} AS ta, {_TERMS('b')} AS tb FROM prs),
k AS (SELECT pair_id, n, cx, CASE WHEN least(len(la), len(lb)) > 0 THEN len(list_filter(range(1, least(len(la), len(lb)) + 1), lambda i: abs(la[i] - lb[i])::DOUBLE / greatest(la[i], lb[i], 1) < 0.3)) / least(len(la), len(lb))::DOUBLE ELSE 0 END AS structure,
CASE WHEN len(list_distinct(list_concat(ta, tb))) > 0 THEN len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))::DOUBLE ELSE 0 END AS jaccard FROM m),
z AS (SELECT pair_id, coalesce(cosine, 0) AS c, structure, jaccard, round(least(0.5::DOUBLE * coalesce(cosine, 0) + 0.3::DOUBLE * structure + 0.2::DOUBLE * jaccard, 1), 6) AS score, least(greatest(CASE WHEN n < 100 THEN 0.6::DOUBLE WHEN cx > 0.8 THEN 0.75::DOUBLE ELSE 0.7::DOUBLE END, 0.5), 0.9) AS threshold FROM k LEFT JOIN dot USING (pair_id))
SELECT pair_id, round(c, 6) AS cosine, round(structure, 6) AS structure, round(jaccard, 6) AS jaccard, score, threshold, CASE WHEN score >= round(threshold + 0.1, 6) THEN 'high' WHEN score >= threshold THEN 'medium' WHEN score >= round(threshold - 0.2, 6) THEN 'low' ELSE 'none' END AS category, round(least(1.2::DOUBLE * score, 0.95::DOUBLE), 6) AS confidence FROM z""")
def enhanced_similarity(spark, sf_dir):
    """Inline pairs, whose ids are made negative, and each document with one passage of the benchmark."""
    refs = table(spark, sf_dir, "benchmark").select((F.col("item_id")).alias("item_id"), F.col("text").alias("b"))
    pairs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("a"), (F.col("doc_id") % 40).alias("item_id")).join(refs, "item_id").select("pair_id", "a", "b")
    return S.pair_similarity(pairs.unionByName(spark.createDataFrame(P.PAIRS, "pair_id long, a string, b string")), "pair_id", "a", "b")


def bigrams_sql(name: str, source: str, keys: str, text: str) -> str:
    """``name``: (keys, place, w, h), each word with the one before it."""
    return rf"{name} AS (SELECT {keys}, generate_subscripts(ws, 1) - 1 AS place, unnest(ws) AS w, unnest(list_prepend('{Q.START}', ws[1:len(ws) - 1])) AS h FROM (SELECT {keys}, regexp_extract_all(lower({text}), '{W}+|[^\p{{L}}\p{{N}}_\s]') AS ws FROM {source}) WHERE len(ws) > 0)"


#: A bigram model with interpolated Kneser-Ney smoothing over all sentences, in the tables kw, kr, kp and kx.
KNESER = rf"""{bigrams_sql('kg', 'sents', 'doc_id, pos', 'sent')}, kc AS (SELECT h, w, count(*) AS c FROM kg GROUP BY ALL), k1 AS (SELECT w, count(*) AS c FROM kc GROUP BY w), kx AS (SELECT count(*) AS v, sum(c)::BIGINT AS n FROM k1),
kw AS (SELECT w, greatest(c - {Q.DISCOUNT}::DOUBLE, 0) / n::DOUBLE + {Q.DISCOUNT}::DOUBLE * v / n * (1.0::DOUBLE / (v + 1)) AS p FROM k1, kx), kr AS (SELECT h, sum(c)::BIGINT AS total, {Q.DISCOUNT}::DOUBLE * count(*) / sum(c)::BIGINT AS rest FROM kc GROUP BY h),
kp AS (SELECT kc.h, kc.w, greatest(c - {Q.DISCOUNT}::DOUBLE, 0) / total + rest * p AS p FROM kc JOIN kr ON kr.h = kc.h JOIN kw ON kw.w = kc.w)"""


@query(rf"""WITH {P.DOCS}, {sent_cte()}, {KNESER}, un AS (SELECT doc_id, -1 AS pos, text AS sent FROM docs UNION ALL SELECT doc_id, pos, sent FROM sents WHERE {words_sql('sent')} >= 4), {bigrams_sql('ug', 'un', 'doc_id, pos', 'sent')},
us AS (SELECT doc_id, ug.pos, CAST(round(-ln(coalesce(kp.p, coalesce(rest, 1) * coalesce(kw.p, (SELECT {Q.DISCOUNT}::DOUBLE * v / n * (1.0::DOUBLE / (v + 1)) FROM kx)))) * 1000000::DOUBLE) AS BIGINT) AS q FROM ug LEFT JOIN kp ON kp.h = ug.h AND kp.w = ug.w LEFT JOIN kr ON kr.h = ug.h LEFT JOIN kw ON kw.w = ug.w WHERE place < {Q.TOKENS}),
pu AS (SELECT doc_id, pos, round(exp(sum(q)::DOUBLE / (count(*) * 1e6::DOUBLE)), 4) AS ppl FROM us GROUP BY ALL HAVING count(*) >= 2),
pd AS (SELECT doc_id, max(CASE WHEN pos < 0 THEN ppl END) AS perplexity, count(CASE WHEN pos >= 0 THEN 1 END) AS m, sum(CASE WHEN pos >= 0 THEN CAST(round(ppl * 10000::DOUBLE) AS HUGEINT) END) AS s, sum(CASE WHEN pos >= 0 THEN CAST(round(ppl * 10000::DOUBLE) AS HUGEINT) * CAST(round(ppl * 10000::DOUBLE) AS HUGEINT) END) AS ss FROM pu GROUP BY doc_id)
SELECT doc_id, m AS n_sentences, perplexity, round(CASE WHEN m > 1 THEN sqrt((m * ss - s * s)::DOUBLE) / (m * 10000::DOUBLE) ELSE 0 END, 6) AS spread, round(100 * greatest(least((60 - perplexity) / 50, 1), 0), 1) AS ai_score FROM pd WHERE perplexity IS NOT NULL""")
def document_perplexity(spark, sf_dir):
    """Perplexity of each document under a bigram model of all of them."""
    docs = papers(spark, sf_dir)
    return G.corpus_perplexity(docs)


@query(f"""WITH {fitted_cte()}, {weigh_cte('a', 'documents', 'doc_id', 'text')}, {weigh_cte('b', 'benchmark', 'item_id', 'text')}, dots AS (SELECT doc_id, item_id, sum(a.w * b.w) AS c FROM a JOIN b USING (term) GROUP BY ALL),
x AS (SELECT doc_id, {_LENS("coalesce(text, '')")} AS la, {_TERMS("coalesce(text, '')")} AS ta, CASE WHEN {words_sql("coalesce(text, '')")} < 100 THEN 0.6::DOUBLE WHEN {complexity_sql("coalesce(text, '')")} > 0.8 THEN 0.75::DOUBLE ELSE 0.7::DOUBLE END AS threshold FROM documents),
y AS (SELECT item_id, {_LENS('text')} AS lb, {_TERMS('text')} AS tb FROM benchmark),
st AS (SELECT doc_id, item_id, threshold, coalesce(list_sum(list_transform(list_zip(la[1:least(len(la), len(lb))], lb[1:least(len(la), len(lb))]), lambda z: CASE WHEN abs(z[1] - z[2])::DOUBLE / greatest(z[1], z[2], 1) < 0.3 THEN 1 ELSE 0 END)) / least(len(la), len(lb))::DOUBLE, 0) AS structure, len(list_intersect(ta, tb)) AS both_n, len(ta) + len(tb) AS total FROM x, y),
sc AS (SELECT st.doc_id, st.item_id, threshold, round(least(0.5::DOUBLE * coalesce(c, 0) + 0.3::DOUBLE * structure + 0.2::DOUBLE * (CASE WHEN total > 0 THEN both_n / (total - both_n)::DOUBLE ELSE 0 END), 1), 6) AS score FROM st LEFT JOIN dots USING (doc_id, item_id)),
mx AS (SELECT doc_id, threshold, max(score) AS maximum FROM sc GROUP BY ALL), kept AS (SELECT doc_id, item_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM sc WHERE score > round(threshold - 0.3, 6) QUALIFY rank <= 5)
SELECT doc_id, threshold, maximum, CASE WHEN maximum >= round(threshold + 0.1, 6) THEN 'high' WHEN maximum >= threshold THEN 'medium' WHEN maximum >= round(threshold - 0.2, 6) THEN 'low' ELSE 'none' END AS category, round(least(1.2::DOUBLE * maximum, 0.95::DOUBLE), 6) AS confidence, coalesce(rank, 0) AS rank, coalesce(item_id, -1) AS item_id, coalesce(score, 0) AS score FROM mx LEFT JOIN kept USING (doc_id)""")
def reference_ranking(spark, sf_dir):
    """Each document against every passage of the benchmark: its best five, its maximum and the verdict; rank 0 if none is listed."""
    return N.ranked_references(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("scored").fillna({"rank": 0, "item_id": -1, "score": 0.0})


_DENSE = "dn AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)"


@query(f"WITH {_DENSE} SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM dn QUALIFY rank <= 4")
def dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return S.dense_topk(v.where("vec_id % 20 = 0"), v)


QUESTIONS = [(1, "the data and the results of a method"), (2, "thition and oner the inea"), (3, "de la elle queux")]


#: Least similarity of the best passage for an answer to be grounded.
GROUNDED = 0.15


def lexical_scores(q: DataFrame, docs: DataFrame) -> DataFrame:
    """TF-IDF cosines of a few given questions and all documents that share a word with them."""
    own = S.own_words(docs, "doc_id", F.col("text"))
    vocab = S.most_frequent(S.word_sums(own), docs.count(), 8000).collect()  # 8000 rows at most
    asked: dict = {}
    for r in S.weigh(q, ["query_id"], F.col("question"), q.sparkSession.createDataFrame(vocab, "term string, idf double"), 1).collect():  # words of the few questions
        asked.setdefault(r.query_id, {})[r.term] = r.w
    return S.cosines(own, {r.term: r.idf for r in vocab}, asked, "doc_id", "long")


@query(f"""WITH q AS (SELECT * FROM {P.values(QUESTIONS, 'query_id, question')}), {grams_cte('dc', 'documents', 'doc_id', 'text')}, vo AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM dc GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 8000), {grams_cte('qc', 'q', 'query_id', 'question')},
dw0 AS (SELECT doc_id, term, tf * idf AS w FROM dc JOIN vo USING (term)), dw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM dw0), qw0 AS (SELECT query_id, term, tf * idf AS w FROM qc JOIN vo USING (term)), qw AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM qw0),
lx AS (SELECT query_id, doc_id, round(sum(dw.w * qw.w), 6) AS lexical FROM dw JOIN qw USING (term) GROUP BY ALL),
ds AS (SELECT query_id, v.vec_id AS doc_id, round(list_inner_product(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS dense FROM q JOIN embeddings e ON e.vec_id = q.query_id JOIN embeddings v ON v.vec_id <> e.vec_id),
j AS (SELECT query_id, doc_id, coalesce(lexical, 0) AS lexical, coalesce(dense, 0) AS dense FROM lx FULL JOIN ds USING (query_id, doc_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) - 1 AS r1, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) - 1 AS r2 FROM j),
fu AS (SELECT query_id, doc_id, round(greatest(dense, 0), 6) AS score, round(1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2), 9) AS fused FROM rk)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS rank FROM fu QUALIFY rank <= 4""")
def hybrid_retrieval_rrf(spark, sf_dir):
    """Passages are the documents; the vector of a document, and of a question, is that of its number."""
    q, docs, v = spark.createDataFrame(QUESTIONS, "query_id long, question string"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    lexical = lexical_scores(q, docs)
    dense = S.dense_scores(v.join(F.broadcast(q), F.col("vec_id") == F.col("query_id")).select("vec_id", "embedding"), v).select("query_id", F.col("vec_id").alias("doc_id"), F.col("similarity").alias("dense"))
    return S.fuse(lexical, dense, ["query_id"], "doc_id")


@query()
def semantic_neighbours(spark, sf_dir):
    """The four documents most like each document whose id is divisible by 20, by vectors fitted on all documents."""
    from inkwell.operators import embedding as E
    from inkwell.operators.tables import stored
    from inkwell.sources.providers import embed

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = stored(embed(docs, "text", E.fit(docs)).select("doc_id", "embedding"), "vectors")
    return S.dense_topk(vectors.where("doc_id % 20 = 0"), vectors, id_col="doc_id")


@query()
def grounded_retrieval(spark, sf_dir):
    """Passages of the documents for questions, by words and by the questions' own vectors, and whether an answer has ground."""
    from inkwell.operators import embedding as E
    from inkwell.operators.tables import stored
    from inkwell.sources.providers import embed

    q, docs = spark.createDataFrame(QUESTIONS, "query_id long, question string"), table(spark, sf_dir, "documents").select("doc_id", "text")
    model = E.fit(docs)
    asked = embed(q, "question", model).select(F.col("query_id").alias("doc_id"), "embedding")
    vectors = stored(embed(docs, "text", model).select((F.col("doc_id") + 1000).alias("doc_id"), "embedding"), "vectors")  # apart from the questions' ids
    dense = S.dense_scores(asked, vectors, id_col="doc_id").select("query_id", (F.col("doc_id") - 1000).alias("doc_id"), F.col("similarity").alias("dense"))
    return S.fuse(lexical_scores(q, docs), dense, ["query_id"], "doc_id").withColumn("grounded", F.max("score").over(Window.partitionBy("query_id")) >= GROUNDED)


@query("SELECT lang, f::INTEGER AS fold, (c - f + 4) // 5 AS rows FROM (SELECT lang, count(*) AS c FROM documents WHERE lang IS NOT NULL GROUP BY lang), range(5) t(f) WHERE c > f")
def stratified_fold_sizes(spark, sf_dir):
    """Rows of each language in each of five exactly stratified folds."""
    from inkwell.operators.voting import stratified_folds

    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang")
    return stratified_folds(rows, "lang").groupBy("lang", "fold").agg(F.count(F.lit(1)).alias("rows"))


@query()
def calibrated_vote(spark, sf_dir):
    """Held-out accuracy and Brier score of the vote on quality, of its members, and of the kernel machine without calibration."""
    from inkwell.operators import voting as E

    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id")
    folded = E.stratified_folds(rows.where("quality IS NOT NULL"), "quality")
    return E.scores(E.fit(folded.where("fold > 0").drop("fold"), "quality"), folded.where("fold = 0").drop("fold"), "quality")


@query("SELECT conv_id, turn, role, length(text) AS n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 3 AND trim(coalesce(text, '')) <> ''")
def recent_turns(spark, sf_dir):
    from inkwell.operators.history import recent_turns as f

    return f(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"), "back")


@query("SELECT conv_id, turn, role, length(text) AS n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 3 AND trim(coalesce(text, '')) <> ''")
def recent_turns_stream(spark, sf_dir):
    """The same from a stream of the table with keyed state, whose changes are kept in a new folder of the shared one."""
    from inkwell.operators.tables import shared_folder
    from inkwell.streaming import turns as E
    from inkwell.streaming.incremental import stream_table

    folder = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    E.use_state_store(spark)
    # a pattern, since a stream of a path without one takes folders only
    stream = E.recent_turns_stream(stream_table(spark, f"{sf_dir}/conversations.parque[t]"))
    E.keep_current(stream, f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    return E.current(spark, f"{folder}/changes").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"), "back")


# structure and terms

_SECTION = f"""ln AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM docs)),
cn AS (SELECT doc_id, pos, line, CASE WHEN {words_sql('line')} <= 8 THEN c END AS canon FROM ln LEFT JOIN {P.values(list(L.SECTIONS.items()), 'h, c')} ON h = {heading_sql('line')}),
nm AS (SELECT *, last_value(canon IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS name FROM cn),
sec AS (SELECT doc_id, name, min(pos) AS ord, trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE canon IS NULL), '')) AS body FROM nm WHERE name IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {P.DOCS}, {_SECTION} SELECT doc_id, name, ord, body FROM sec")
def section_split(spark, sf_dir):
    return T.sections(papers(spark, sf_dir)).withColumn("ord", F.col("ord").cast("long"))


@query(f"WITH {P.DOCS}, {_SECTION} SELECT doc_id, name AS section, ord AS found_at FROM sec WHERE name NOT IN (SELECT section FROM {P.values(L.templates(), 'paper_type, ord, section, lo, hi')} WHERE paper_type = 'empirical') AND name <> 'Methodology'")
def extra_sections(spark, sf_dir):
    return X.extra_sections(papers(spark, sf_dir))


@query(f"WITH {P.DOCS}, {_SECTION}, a AS (SELECT doc_id, name AS section, {_MARKERS('body')} AS markers, {words_sql('body')} AS n_words FROM sec) SELECT *, round(markers * 1000.0::DOUBLE / n_words, 6) AS per_1000 FROM a WHERE n_words > 0")
def section_citations(spark, sf_dir):
    return Y.section_citations(papers(spark, sf_dir))


@query(rf"""WITH {P.DOCS}, lo AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM docs)), l2 AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare FROM lo),
l3 AS (SELECT *, regexp_matches(lower(bare), '{'|'.join(L.LOOSE_HEADERS)}') AND length(bare) < 100 AS opens FROM l2), l4 AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS part FROM l3),
p AS (SELECT doc_id, part, coalesce(max(bare) FILTER (WHERE opens), 'content') AS name, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT opens) AS body, count(*) FILTER (WHERE NOT opens) AS n FROM l4 GROUP BY ALL)
SELECT doc_id, name, md5(arg_max(body, part)) AS body_md5 FROM p WHERE n > 0 GROUP BY doc_id, name""")
def loose_sections(spark, sf_dir):
    return T.loose_sections(papers(spark, sf_dir)).select("doc_id", "name", F.md5("body").alias("body_md5"))


_ENTRIES = rf"""en0 AS (SELECT doc_id, CASE WHEN regexp_matches(trim(text), '\n\s*\n') THEN list_transform(string_split_regex(trim(text), '\n\s*\n'), lambda b: regexp_replace(trim(b), '\s+', ' ', 'g')) ELSE string_split(trim(text), chr(10)) END AS parts FROM docs),
en1 AS (SELECT doc_id, list_filter(list_transform(parts, lambda e: trim(regexp_replace(trim(e), '^[\[(]?\s*\d+\s*[\]).:]\s*', ''))), lambda e: {words_sql('e')} >= 4) AS es FROM en0), ent AS (SELECT doc_id, generate_subscripts(es, 1) - 1 AS pos, unnest(es) AS entry FROM en1)"""


@query(f"WITH {P.DOCS}, {_ENTRIES} SELECT doc_id, pos, md5(entry) AS entry_md5 FROM ent")
def reference_entries(spark, sf_dir):
    return T.reference_entries(papers(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("entry").alias("entry_md5"))


_CHECK = f"""{_SECTION}, tp AS (SELECT ord AS o, section, lo, hi, CASE WHEN section = 'Methods' THEN 'Methodology' ELSE section END AS canon FROM {P.values(L.templates(), 'paper_type, ord, section, lo, hi')} WHERE paper_type = 'empirical' AND section <> 'Title'),
fo AS (SELECT doc_id, CASE WHEN name = 'Methods' THEN 'Methodology' ELSE name END AS canon, min(ord) AS found_at, CAST(sum({words_sql('body')}) AS BIGINT) AS n FROM sec GROUP BY ALL),
chk AS (SELECT d.doc_id, o AS ord, section, n AS n_words, CASE WHEN found_at IS NULL THEN 'missing' WHEN lo IS NULL THEN 'present' WHEN n < lo THEN 'under' WHEN n > hi THEN 'over' ELSE 'ok' END AS status, found_at FROM docs d CROSS JOIN tp LEFT JOIN fo ON fo.doc_id = d.doc_id AND fo.canon = tp.canon)"""


@query(f"WITH {P.DOCS}, {_CHECK} SELECT * FROM chk")
def structure_check(spark, sf_dir):
    return X.structure_check(papers(spark, sf_dir))


@query(f"WITH {P.DOCS}, {_CHECK}, t AS (SELECT doc_id, count(found_at) AS present, count(*) - count(found_at) AS missing, list(found_at ORDER BY ord) FILTER (WHERE found_at IS NOT NULL) AS ats FROM chk GROUP BY ALL) SELECT doc_id, present, missing, round(100.0::DOUBLE * present / greatest(present + missing, 1), 6) AS completeness, coalesce(ats = list_sort(ats), true) AS order_ok FROM t")
def structure_completeness(spark, sf_dir):
    return X.structure_totals(X.structure_check(papers(spark, sf_dir)))


_ABS = f"""{_SECTION}, ab AS (SELECT d.doc_id, body IS NOT NULL AS had_heading, coalesce(body, trim(text)) AS x FROM docs d LEFT JOIN sec ON sec.doc_id = d.doc_id AND name = 'Abstract'),
mv AS (SELECT doc_id, had_heading, {', '.join(f"regexp_matches(x, {quoted('(?i)' + p)}) AS {k}" for k, p in L.MOVES.items())}, len(list_filter(regexp_extract_all(x, '{TOKEN}'), lambda w: regexp_matches(w, '[A-Za-z0-9]'))) AS n_words FROM ab WHERE x <> ''),
m2 AS (SELECT *, {' + '.join(f'{k}::BIGINT' for k in L.MOVES)} AS moves, CASE WHEN n_words < 150 THEN 'under' WHEN n_words > 250 THEN 'over' ELSE 'ok' END AS status FROM mv)"""


@query(f"WITH {P.DOCS}, {_ABS} SELECT *, moves * 14 + CASE WHEN status = 'ok' THEN 30 ELSE 15 END AS score FROM m2")
def abstract_scorecard(spark, sf_dir):
    return X.abstract_scorecard(papers(spark, sf_dir))


_ACRONYMS = lambda t: rf"regexp_extract_all(regexp_replace(' ' || {t} || ' ', '({NW})', '\1\1', 'g'), '{NW}([A-Z][A-Z0-9]{{1,5}})s?{NW}', 1)"


@query(rf"""WITH {P.DOCS}, us AS (SELECT doc_id, acronym, count(*) AS uses FROM (SELECT doc_id, unnest({_ACRONYMS('text')}) AS acronym FROM docs) WHERE NOT list_contains({listed(L.IGNORED_ACRONYMS)}, acronym) GROUP BY ALL),
df AS (SELECT doc_id, acronym, count(DISTINCT lower(trim(regexp_replace(long, '\s+', ' ', 'g')))) AS expansions FROM (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(L.DEFINITION)}, 1)) AS long, unnest(regexp_extract_all(text, {quoted(L.DEFINITION)}, 2)) AS acronym FROM docs) GROUP BY ALL),
al AS (SELECT us.doc_id, us.acronym, uses, expansions, list_contains({_ACRONYMS("CASE WHEN contains(text, '(' || us.acronym) THEN left(text, instr(text, '(' || us.acronym) - 1) ELSE text END")}, us.acronym) AS early FROM us LEFT JOIN df USING (doc_id, acronym) JOIN docs USING (doc_id))
SELECT doc_id, acronym, uses, coalesce(expansions, 0) AS expansions, CASE WHEN expansions IS NULL AND NOT list_contains({listed(L.COMMON_CAPITALS)}, acronym) THEN 'undefined' WHEN expansions > 1 THEN 'differing' WHEN expansions IS NOT NULL AND early THEN 'used before defined' END AS issue FROM al""")
def acronym_issues(spark, sf_dir):
    return X.acronyms(papers(spark, sf_dir))


@query(rf"""WITH {P.DOCS}, s AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z\-]+[A-Za-z]'))) AS s FROM docs), c AS (SELECT doc_id, replace(s, '-', '') AS term, s, count(*) AS n FROM s WHERE length(replace(s, '-', '')) >= 4 GROUP BY ALL),
g AS (SELECT doc_id, term, count(*) AS variants, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, term) AS rank FROM g WHERE variants > 1 AND total >= 3 QUALIFY rank <= 20""")
def term_variants(spark, sf_dir):
    return X.term_variants(papers(spark, sf_dir))


_ADD = f"lambda a, s: CASE WHEN a.n + {words_sql('s')} >= 130 THEN {{'done': list_append(a.done, array_to_string(list_append(a.opened, s), ' ')), 'opened': [s], 'n': {words_sql('s')}}} ELSE {{'done': a.done, 'opened': list_append(a.opened, s), 'n': a.n + {words_sql('s')}}} END"


@query(rf"""WITH {P.DOCS}, {_SECTION}, sn AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM docs WHERE text IS NOT NULL),
fo AS (SELECT doc_id, list_reduce(ss, {_ADD}, {{'done': []::VARCHAR[], 'opened': []::VARCHAR[], 'n': 0::BIGINT}}) AS f FROM sn),
al AS (SELECT doc_id, CASE WHEN len(f.opened) > CASE WHEN len(f.done) > 0 THEN 1 ELSE 0 END THEN list_append(f.done, array_to_string(f.opened, ' ')) ELSE f.done END AS cs FROM fo),
un AS (SELECT doc_id, generate_subscripts(cs, 1) AS i, unnest(cs) AS chunk FROM al), ck AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS chunk_id FROM un GROUP BY doc_id, chunk),
tk AS (SELECT doc_id, chunk_id, unnest(list_distinct(regexp_extract_all(lower(chunk), '[a-z0-9]+'))) AS t FROM ck), st AS (SELECT doc_id, name, ord, unnest(list_distinct(regexp_extract_all(lower(body), '[a-z0-9]+'))) AS t FROM sec),
sh AS (SELECT tk.doc_id, chunk_id, name, ord, count(*) AS shared FROM tk JOIN st ON tk.doc_id = st.doc_id AND tk.t = st.t GROUP BY ALL), bs AS (SELECT doc_id, chunk_id, name FROM sh QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY shared DESC, ord, name DESC) = 1)
SELECT ck.doc_id, ck.chunk_id, {words_sql('chunk')} AS n_words, name AS section FROM ck LEFT JOIN bs ON bs.doc_id = ck.doc_id AND bs.chunk_id = ck.chunk_id""")
def chunk_sections(spark, sf_dir):
    return X.chunk_sections(papers(spark, sf_dir))


_TYPES = " UNION ALL ".join(f"SELECT doc_id, {i} AS o, {P.literal(k)} AS paper_type, {' + '.join(f'contains(t, {P.literal(w)})::BIGINT' for w in ws)} AS score FROM lo" for i, (k, ws) in enumerate(L.TYPE_KEYWORDS.items()))


@query(f"WITH {P.DOCS}, lo AS (SELECT doc_id, coalesce(lower(text), '') AS t FROM docs), ty AS ({_TYPES}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) AS rank FROM ty QUALIFY rank <= 3) SELECT doc_id, rank, paper_type, score, round(least(score / 5::DOUBLE, 0.95::DOUBLE), 6) AS confidence FROM r")
def paper_type_keywords(spark, sf_dir):
    return X.paper_types(papers(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit(""))))


_HITS = lambda ws: "(" + " + ".join(f"contains(lo, {P.literal(w)})::BIGINT" for w in ws) + ")"


def _vote(table: dict[str, list[str]]) -> str:
    return "list_max([" + ", ".join(f"{{'n': {_HITS(ws)}, 'o': {-i}, 'k': {P.literal(k)}}}" for i, (k, ws) in enumerate(table.items())) + "]).k"


def _chain(chain: list[tuple[str, list[str]]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {_HITS(ws)} > 0 THEN {P.literal(k)}" for k, ws in chain) + f" ELSE {P.literal(otherwise)} END"


_LOW = "lw AS (SELECT doc_id, text, lower(coalesce(text, '')) AS lo FROM docs)"


@query(f"WITH {P.DOCS}, {_LOW} SELECT doc_id, {_vote(K.CONTENT_TYPES)} AS type_vote, {_vote(K.CONTENT_FIELDS)} AS field_vote, {_chain(K.TYPE_CHAIN, 'empirical')} AS type_chain, {_chain(K.FIELD_CHAIN, 'computer_science')} AS field_chain FROM lw")
def type_and_field_rules(spark, sf_dir):
    return V.votes(papers(spark, sf_dir))


_SHARE = lambda groups: "greatest(" + ", ".join(f"{_HITS(g)} / {len(g)}.0::DOUBLE" for g in groups) + ")"


@query(rf"""WITH {P.DOCS}, {_LOW}, a AS (SELECT doc_id, lo, {words_sql('lo')} AS n, {complexity_sql("coalesce(text, '')")} AS cx,
list_reverse_sort([{', '.join(_HITS(ws) for ws in K.TOPIC_TYPES.values())}]) AS c, {_vote(K.TOPIC_TYPES)} AS best, {', '.join(f'{_HITS(ws)} / 5.0::DOUBLE AS {k}' for k, ws in K.INDICATORS.items())}, {_SHARE(K.FIELD_HINTS)} AS field, {_SHARE(K.APPROACH_HINTS)} AS ap FROM lw)
SELECT doc_id, CASE WHEN n = 0 THEN 'unknown' ELSE best END AS predicted, CASE WHEN n = 0 THEN 0 ELSE round(least(greatest(0.6::DOUBLE * c[1] / greatest(n, 1) + 0.2::DOUBLE * (1 - CASE WHEN c[1] > 0 THEN c[2]::DOUBLE / c[1] ELSE 0 END) + 0.2::DOUBLE * field, 0.1::DOUBLE), 0.95::DOUBLE), 6) END AS confidence,
round(c[1]::DOUBLE / greatest(n, 1), 6) AS density, round(cx, 6) AS complexity, specificity, methodology, analysis, field, round(ap, 6) AS approach FROM a""")
def topic_type_features(spark, sf_dir):
    return V.topic_features(papers(spark, sf_dir))


_ENH = r"regexp_replace(regexp_replace(regexp_replace(lower(text), '\([^)]*\)', '', 'g'), '\[\d+\]', '', 'g'), '[a-z]+ et al\.', '', 'g')"
for _a, _b in [*K.ABBREVIATIONS, *((p, "") for p in K.STOCK_PHRASES)]:
    _ENH = f"replace({_ENH}, {P.literal(_a)}, {P.literal(_b)})"


@query(f"WITH {P.DOCS} SELECT doc_id, md5(array_to_string(list_filter(regexp_extract_all({_ENH}, '{W}+'), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w)), ' ')) AS enhanced_md5 FROM docs")
def enhanced_normal_forms(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", F.md5(V.enhanced_normal(F.col("text"))).alias("enhanced_md5"))


def _stems_sql(w: str) -> str:
    cases = [f"CASE WHEN {w} LIKE '%{a}' AND length({w}) >= {2 + len(a) - len(b)}" + (f" AND NOT regexp_matches({w}, '{M.SINGULAR_ENDS}')" if a == "s" else "") + f" THEN left({w}, length({w}) - {len(a)}) || '{b}' END" for a, b in M.SUFFIXES]
    return "list_distinct(list_filter([" + ", ".join(cases) + "], lambda x: x IS NOT NULL))"


@query(rf"""WITH {P.DOCS}, ws AS (SELECT doc_id, list_filter(regexp_extract_all({_ENH}, '{W}+'), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w)) AS a FROM docs),
ex AS (SELECT doc_id, generate_subscripts(a, 1) AS pl, unnest(a) AS word FROM ws), lx AS (SELECT word, count(*) AS n FROM ex GROUP BY word), ir AS (SELECT * FROM {P.values(list(M.IRREGULAR.items()), 'word, lemma')}),
tr AS (SELECT word, unnest({_stems_sql('word')}) AS lemma FROM lx WHERE word NOT IN (SELECT word FROM ir)),
lm AS (SELECT tr.word, first(lemma ORDER BY length(lemma), lemma) AS lemma FROM tr JOIN lx ON lx.word = tr.lemma WHERE lx.n >= {M.LEAST} GROUP BY tr.word),
al AS (SELECT * FROM lm UNION ALL SELECT * FROM ir)
SELECT d.doc_id, count(al.lemma) AS n_changed, md5(coalesce(string_agg(coalesce(al.lemma, ex.word), ' ' ORDER BY pl), '')) AS lemmas_md5 FROM docs d LEFT JOIN ex USING (doc_id) LEFT JOIN al ON al.word = ex.word GROUP BY d.doc_id""")
def lemmatised_forms(spark, sf_dir):
    """Each document's enhanced normal form with nouns in their base forms, and how many words these changed."""
    own = M.gathered(papers(spark, sf_dir), V.enhanced_words(F.col("text")))
    lemmas = M.fit(own.select(F.explode(F.flatten("_ws")).alias("word")))
    return M.in_texts(own, lemmas).select("doc_id", "n_changed", F.md5("lemmas").alias("lemmas_md5"))


_OF_TYPE = f"WITH {P.DOCS}, lo AS (SELECT doc_id, coalesce(lower(text), '') AS t FROM docs), ty AS ({_TYPES}), kd AS (SELECT doc_id, arg_max(paper_type, score * 100 - o) AS paper_type FROM ty GROUP BY doc_id)"


@query(f"{_OF_TYPE} SELECT doc_id, paper_type, section, CAST(greatest(120, least(coalesce(hi, 250), 350)) AS BIGINT) AS target FROM kd JOIN {P.values(L.templates(), 'paper_type, ord, section, lo, hi')} USING (paper_type)")
def section_targets(spark, sf_dir):
    """Sections that a document of its likeliest type should have, and the words to write for each."""
    from inkwell.operators.prompts import section_limits

    return X.of_type(papers(spark, sf_dir), section_limits(), "section string, target long")


_GUIDANCE = [(k, s, ", ".join(x)) for k, (s, x) in K.GUIDANCE.items()]


@query(f"{_OF_TYPE} SELECT doc_id, paper_type, content_style, key_sections FROM kd JOIN {P.values(_GUIDANCE, 'paper_type, content_style, key_sections')} USING (paper_type)")
def type_guidance(spark, sf_dir):
    """What to heed in a document of its likeliest type."""
    return X.of_type(papers(spark, sf_dir), _GUIDANCE, "content_style string, key_sections string")


# references and review

def _plain_sql(x: str) -> str:
    for entity, char in B.ENTITIES:
        x = f"replace({x}, {P.literal(entity)}, {P.literal(char)})"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


_META = lambda name: _plain_sql(f"regexp_extract(h, {quoted(B.META % name)}, 1)")
#: Inline references, below the pages' ids, and the pages as references.
_RECORDS = rf"""(SELECT -id AS id, title, authors, year, journal, publisher, doi, url FROM {P.values(P.REFERENCES, 'id, title, authors, year, journal, publisher, doi, url')} UNION ALL
SELECT page_id, {_plain_sql(f"regexp_extract(h, {quoted(B.TITLE)}, 1)")}, list_transform(list_filter(list_transform(regexp_extract_all(h, {quoted(B.META % 'author')}, 1), lambda n: {_plain_sql('n')}), lambda n: n <> ''), lambda n: {{'given': trim(regexp_replace(n, '\S+$', '')), 'family': regexp_extract(n, '\S+$')}}),
regexp_extract({_META('(?:publication_)?date')}, '(?:19|20)\d\d'), {_META('journal_title')}, regexp_extract(lower(u), {quoted(B.HOST)}, 1), regexp_replace(regexp_extract({_META('doi')}, {quoted(B.DOI)}), '\.+$', ''), u FROM (SELECT page_id, coalesce(html, '') AS h, coalesce(url, '') AS u FROM pages))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as references, and the inline ones."""
    inline = spark.createDataFrame(P.REFERENCES, B.REFERENCE).withColumn("id", -F.col("id"))
    return B.cited_pages(table(spark, sf_dir, "pages")).unionByName(inline)


@query(rf"""WITH r AS (SELECT *, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS k0 FROM {_RECORDS}), k AS (SELECT *, CASE WHEN k0 = '' THEN '#' || id ELSE k0 END AS k FROM r)
SELECT id, min(id) OVER (PARTITION BY k) AS place FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doi <> '' DESC, len(authors) DESC, id) = 1""")
def dedupe_best_record(spark, sf_dir):
    return B.best_records(records(spark, sf_dir))


@query("SELECT min(doc_id) AS id, min(doc_id) AS place FROM documents GROUP BY CASE WHEN trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) = '' THEN '#' || doc_id ELSE trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) END")
def dedupe_documents_by_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.lit(None).cast("string").alias("doi"), F.array().cast("array<string>").alias("authors"))
    return B.best_records(docs)


_PARTED = lambda *parts: "array_to_string(list_filter([" + ", ".join(parts) + "], lambda p: p IS NOT NULL AND p <> ''), ' ')"
_END = lambda c, e: f"CASE WHEN {c} <> '' THEN {c} || '{e}' END"
_INITIALS = r"array_to_string(list_transform(list_filter(string_split_regex(replace(coalesce(a.given, ''), '.', ' '), '\s+'), lambda p: p <> ''), lambda p: upper(left(p, 1)) || '.'), ' ')"
_LISTED = lambda n, last: f"CASE WHEN len({n}) = 0 THEN '' WHEN len({n}) > 6 THEN array_to_string({n}[1:6], ', ') || ', et al.' WHEN len({n}) = 1 THEN {n}[1] ELSE array_to_string({n}[1:len({n}) - 1], ', ') || '{last}' || {n}[len({n})] END"
_WHOLE = lambda a: f"regexp_replace(trim(coalesce({a}.family, '') || ', ' || coalesce({a}.given, '')), ',+$', '')"


@query(f"""WITH r AS (SELECT id, coalesce(title, '') AS title, coalesce(year, '') AS yr, coalesce(doi, '') AS doi, coalesce(url, '') AS url, CASE WHEN coalesce(journal, '') <> '' THEN journal ELSE coalesce(publisher, '') END AS src, authors, list_filter(authors, lambda a: coalesce(a.family, '') <> '') AS named FROM {_RECORDS}),
n AS (SELECT *, CASE WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE url END AS link, list_transform(named, lambda a: regexp_replace(trim(a.family || ', ' || {_INITIALS}), ',+$', '')) AS apa_n, list_transform(named, lambda a: trim({_INITIALS} || ' ' || a.family)) AS ieee_n,
CASE WHEN len(authors) = 0 THEN '' WHEN len(authors) = 1 THEN {_WHOLE('authors[1]')} WHEN len(authors) = 2 THEN {_WHOLE('authors[1]')} || ', and ' || {_PARTED('authors[2].given', 'authors[2].family')} ELSE {_WHOLE('authors[1]')} || ', et al.' END AS mla_n FROM r),
f AS (SELECT *, {_LISTED('apa_n', ', & ')} AS apa_a, {_LISTED('ieee_n', ', ')} AS ieee_a FROM n)
SELECT id, {_PARTED('apa_a', "CASE WHEN yr <> '' THEN '(' || yr || ').' END", "title || '.'", _END('src', '.'))} || CASE WHEN link <> '' THEN ' ' || link ELSE '' END AS apa,
{_PARTED(_END('ieee_a', ','), "'" + '"' + "' || title || CASE WHEN src <> '' OR yr <> '' THEN '," + '"' + "' ELSE '." + '"' + "' END", "CASE WHEN src <> '' THEN src || CASE WHEN yr <> '' THEN ',' ELSE '.' END END", _END('yr', '.'))} || CASE WHEN doi <> '' THEN ' doi: ' || doi || '.' WHEN url <> '' THEN ' [Online]. Available: ' || url || '.' ELSE '' END AS ieee,
{_PARTED(_END('mla_n', '.'), "'" + '"' + "' || title || '." + '"' + "'", _END('src', ','), _END('yr', '.'))} || CASE WHEN link <> '' THEN ' ' || link || '.' ELSE '' END AS mla FROM f""")
def reference_formats(spark, sf_dir):
    return records(spark, sf_dir).select("id", *[B.formatted(s).alias(s.lower()) for s in ("APA", "IEEE", "MLA")])


_RTOK = lambda c: rf"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains({listed(L.REFERENCE_STOP_WORDS)}, t)))"


_INLINE_RECORDS = P.values(P.REFERENCES, "id, title, authors, year, journal, publisher, doi, url")
_VERDICTS = lambda entries, catalogue: rf"""e AS (SELECT entry_id, lower(regexp_replace(regexp_extract(entry, '(?i)10\.\d{{4,9}}/[^\s,;\])]+'), '\.+$', '')) AS ed, {_RTOK('entry')} AS et FROM {entries}),
c AS (SELECT id, lower(coalesce(doi, '')) AS fd, {_RTOK('title')} AS tt FROM {catalogue}),
sh AS (SELECT entry_id, id, fd, ne, nt, count(*) AS o FROM (SELECT entry_id, len(et) AS ne, unnest(et) AS t FROM e) JOIN (SELECT id, fd, len(tt) AS nt, unnest(tt) AS t FROM c) USING (t) GROUP BY ALL),
m AS (SELECT entry_id, id, fd, 1.0::DOUBLE AS f1, len(tt) AS nt, true AS by_doi FROM e JOIN c ON ed = fd AND ed <> '' UNION ALL SELECT entry_id, id, fd, round(2.0::DOUBLE * o / (nt + greatest(ne, 1)), 6), nt, false FROM sh),
b AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY by_doi DESC, f1 DESC, id) AS r FROM m QUALIFY r = 1),
v AS (SELECT e.entry_id, ed, id, fd, coalesce(f1, 0) AS f1, nt, coalesce(by_doi, false) AS bd FROM e LEFT JOIN b USING (entry_id)), w AS (SELECT *, CASE WHEN bd OR (f1 >= 0.7 AND nt >= 4) THEN 'Verified' WHEN f1 >= 0.4 THEN 'Possible match' ELSE 'Not found' END AS verdict FROM v)"""  # noqa: E731


@query(f"""WITH {P.DOCS}, {_ENTRIES}, fi AS (SELECT doc_id * 20 + pos AS entry_id, entry FROM ent WHERE pos < 20), {_VERDICTS('fi', _INLINE_RECORDS)}, sz AS (SELECT doc_id, count(*) AS entries FROM ent GROUP BY doc_id)
SELECT sz.doc_id, any_value(entries) AS entries, count(*) FILTER (WHERE verdict = 'Verified') AS verified, count(*) FILTER (WHERE verdict = 'Possible match') AS possible, count(*) FILTER (WHERE verdict = 'Not found') AS not_found, any_value(entries) > 20 AS truncated FROM sz JOIN w ON CAST(floor(entry_id / 20) AS BIGINT) = sz.doc_id GROUP BY sz.doc_id""")
def checked_lists(spark, sf_dir):
    return B.checked_lists(papers(spark, sf_dir), spark.createDataFrame(P.REFERENCES, B.REFERENCE))


@query(rf"""WITH {_VERDICTS(f"(SELECT -entry_id AS entry_id, entry FROM {P.values(P.ENTRIES, 'entry_id, entry')} UNION ALL SELECT item_id, text FROM benchmark)", _RECORDS)}
SELECT entry_id, verdict, f1 AS confidence, id AS matched_id, coalesce(verdict = 'Verified' AND NOT bd AND ed <> '' AND fd <> '' AND ed <> fd, false) AS doi_mismatch FROM w""")
def reference_verdicts(spark, sf_dir):
    """Which passages of the benchmark cite a known reference: inline ones and pages."""
    entries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry_id"), F.col("text").alias("entry"))
    inline = spark.createDataFrame(P.ENTRIES, "entry_id long, entry string").withColumn("entry_id", -F.col("entry_id"))
    return B.verdicts(entries.unionByName(inline), records(spark, sf_dir))


ITEM = "paper long, index int, score double, weight double, severity string, unavailable boolean"
_WORDS_OF = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains(" + listed(L.REFERENCE_STOP_WORDS) + ", w)))"
#: Inline items, below the documents' ids, and the default rubric scored for each document.
_ITEMS = rf"""(SELECT -paper AS paper, index, score::DOUBLE AS score, weight::DOUBLE AS weight, severity, unavailable FROM {P.values(P.ITEMS, "paper, index, score, weight, severity, unavailable")} UNION ALL
SELECT doc_id, i, score::DOUBLE, weight, CASE WHEN score < 20 THEN 'Critical' WHEN score < 40 THEN 'Major' WHEN score < 60 THEN 'Minor' ELSE 'None' END, blank FROM (SELECT doc_id, i, weight::DOUBLE AS weight, blank, CASE WHEN blank THEN 0 ELSE (100 * len(list_intersect(want, have))) // greatest(1, len(want)) END AS score
FROM (SELECT doc_id, {_WORDS_OF.format("coalesce(text, '')")} AS have, trim(coalesce(text, '')) = '' AS blank FROM documents), (SELECT i, weight, {_WORDS_OF.format('content')} AS want FROM {P.values([(i, w, c) for i, (w, c) in enumerate(L.RUBRIC)], 'i, weight, content')})))"""


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default rubric scored for each document, and the inline items."""
    inline = spark.createDataFrame(P.ITEMS, ITEM).withColumn("paper", -F.col("paper"))
    return R.covered_items(table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "paper").unionByName(inline)


@query(f"""WITH i AS (SELECT *, CASE WHEN weight IS NULL THEN 1.0 WHEN weight < 0 THEN 0 ELSE weight END::DOUBLE AS w FROM {_ITEMS}), g AS (SELECT paper, coalesce(sum(score * w) FILTER (WHERE NOT unavailable), 0) AS sw, coalesce(sum(w) FILTER (WHERE NOT unavailable), 0) AS s, avg(score) FILTER (WHERE NOT unavailable) AS p, count(*) FILTER (WHERE NOT unavailable) AS scored, count(*) FILTER (WHERE unavailable) AS skipped FROM i GROUP BY ALL)
SELECT paper, round(CASE WHEN s > 0 THEN sw / s ELSE coalesce(p, 0) END, 6)::DOUBLE AS total, scored, skipped FROM g""")
def rubric_total(spark, sf_dir):
    return R.rubric_total(scored_items(spark, sf_dir), ["paper"])


@query(f"""SELECT paper, row_number() OVER (PARTITION BY paper ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'Major' THEN 1 WHEN 'Minor' THEN 2 WHEN 'None' THEN 4 ELSE 3 END, coalesce(weight, 0) * (100 - score) DESC, index) AS place, index, severity, score::DOUBLE AS score FROM {_ITEMS} WHERE NOT unavailable AND (severity IN ('Critical', 'Major', 'Minor') OR score < 60) QUALIFY place <= 6""")
def revision_plan(spark, sf_dir):
    return R.revision_plan(scored_items(spark, sf_dir), ["paper"])


@query(f"SELECT doc_id, i AS item, weight::DOUBLE AS weight, content FROM documents, {P.values([(i, w, c) for i, (w, c) in enumerate(L.RUBRIC)], 'i, weight, content')} WHERE trim(coalesce(text, '')) <> ''")
def default_rubric(spark, sf_dir):
    """The rubric that stands in for each document when no backend writes one."""
    from inkwell.operators.review import rubrics

    return rubrics(table(spark, sf_dir, "documents")).select("doc_id", F.col("index").alias("item"), "weight", "content")


#: Inline replies as turns of a conversation -1, and the assistant's turns.
_REPLIES = lambda inline: f"(SELECT -1 AS conv_id, turn, raw FROM {P.values(inline, 'turn, raw')} UNION ALL SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')"


def replies(spark: SparkSession, sf_dir: str, inline: list[tuple]) -> DataFrame:
    """The assistant's turns of all conversations, and inline ones."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("raw"))
    return turns.unionByName(spark.createDataFrame(inline, "turn long, raw string").withColumn("conv_id", F.lit(-1).cast("long")))


_SENTINEL = " OR ".join(f"starts_with(lower(trim(coalesce(raw, ''))), {P.literal(p)})" for p in L.UNAVAILABLE)


@query(rf"""WITH r AS (SELECT *, json_extract_string(CASE WHEN regexp_extract(raw, '(?s)\{{[^{{}}]*"score"[^{{}}]*\}}') <> '' THEN regexp_extract(raw, '(?s)\{{[^{{}}]*"score"[^{{}}]*\}}') END, '$.score') AS o, regexp_extract_all(raw, '(?i)"?score"?\s*[:=]\s*(\d{{1,3}})', 1) AS s, regexp_extract_all(raw, '(?i)score\D{{0,6}}(\d{{1,3}})', 1) AS l FROM {_REPLIES(P.REPLIES)})
SELECT conv_id, turn, CAST(greatest(0, least(100, trunc(coalesce(try_cast(coalesce(o, CASE WHEN len(s) > 0 THEN s[-1] WHEN len(l) > 0 THEN l[-1] END) AS DOUBLE), 0)))) AS BIGINT) AS score, trim(coalesce(raw, '')) = '' OR {_SENTINEL} AS unavailable FROM r""")
def score_replies(spark, sf_dir):
    return replies(spark, sf_dir, P.REPLIES).select("conv_id", "turn", R.parsed_score(F.col("raw")).alias("score"), R.unavailable(F.col("raw")).alias("unavailable"))


def _word_count(text: str, word: str) -> str:
    """Whole-word matches in any case, in text whose non-word characters stand twice."""
    return n_found(text, f"{NW}{re.escape(word)}{NW}", "i")


_WIDE = rf"regexp_replace(' ' || text || ' ', '({NW})', '\1\1', 'g')"
_GRAMMAR = {k: " + ".join(_word_count("d", w) for w, _, kind in L.GRAMMAR_WORDS if kind == k) for k in ("Grammar", "Spelling")}


@query(f"WITH {P.DOCS}, a AS (SELECT doc_id, text, {_WIDE} AS d FROM docs) SELECT doc_id, {_GRAMMAR['Grammar']} AS grammar, {_GRAMMAR['Spelling']} AS spelling, {' + '.join(n_found('text', p) for p in L.GRAMMAR_PUNCTUATION)} AS punctuation FROM a")
def grammar_fallback_counts(spark, sf_dir):
    return R.grammar_counts(papers(spark, sf_dir))


def _present(terms: list[str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lo, {quoted(f'(?:^|{NW}){re.escape(t)}(?:$|{NW})'.replace(chr(92) + ' ', ' '))}) THEN {P.literal(t)} END" for t in sorted(terms)) + "], lambda x: x IS NOT NULL), '|')"


_HYGIENE = rf"""a AS (SELECT doc_id, text, lower(text) AS lo FROM docs), hy AS (SELECT doc_id, contains(text, '—') AS em_dash, regexp_matches(regexp_replace(text, '\d\s*–\s*\d', '', 'g'), '\s–|–\s') AS en_dash, regexp_matches(text, {quoted(L.PLACEHOLDER)}) AS placeholders,
CASE WHEN text IS NOT NULL THEN array_to_string(list_sort(list_distinct(regexp_extract_all(lo, {quoted(L.AI_TELLS)}))), '|') END AS ai_tells, {_present(L.ESCAPE_HATCHES)} AS escape_hatches, {_present(L.HOLLOW_ADVERBS)} AS hollow, {_present(L.VAGUE_QUANTIFIERS)} AS vague FROM a)"""


@query(f"WITH {P.DOCS}, {_HYGIENE} SELECT * FROM hy")
def hygiene_scan(spark, sf_dir):
    return R.hygiene(papers(spark, sf_dir))


_PARTS = lambda c: f"list_filter(string_split(coalesce({c}, ''), '|'), lambda x: x <> '')"


@query(f"""WITH {P.DOCS}, {_HYGIENE}, z AS (SELECT doc_id, list_sort(list_distinct(list_concat(list_filter([CASE WHEN em_dash THEN 'em dash' END, CASE WHEN en_dash THEN 'en dash used as punctuation' END, CASE WHEN placeholders THEN 'placeholder token' END], lambda x: x IS NOT NULL), {_PARTS('ai_tells')}, {_PARTS('escape_hatches')}))) AS issues FROM hy WHERE em_dash IS NOT NULL)
SELECT doc_id, len(issues) AS n_issues, array_to_string(issues[1:12], '|') AS terms FROM z WHERE len(issues) > 0""")
def hygiene_issues(spark, sf_dir):
    return R.hygiene_issues(papers(spark, sf_dir))


_AROUND = "CASE WHEN position > 50 THEN '...' ELSE '' END || substr(text, greatest(position - 50, 0) + 1, least(position + length(original) + 50, length(text)) - greatest(position - 50, 0)) || CASE WHEN position + length(original) + 50 < length(text) THEN '...' ELSE '' END"
#: (key, match, length of what stands between it and the one before) of a rule of punctuation.
_SPACED = " UNION ALL ".join(f"SELECT doc_id, {len(L.GRAMMAR_WORDS) + i} AS rule, generate_subscripts(m, 1) AS k, unnest(m) AS original, unnest(list_transform(p[1:len(m)], lambda x: length(x))) AS gap FROM (SELECT doc_id, regexp_extract_all(text, {quoted(x)}) AS m, string_split_regex(text, {quoted(x)}) AS p FROM docs) WHERE len(m) > 0" for i, x in enumerate(L.GRAMMAR_PUNCTUATION))


@query(rf"""WITH {P.DOCS}, ru AS (SELECT * FROM {P.values([(i, w, fix, kind) for i, (w, fix, kind) in enumerate(L.GRAMMAR_WORDS)], 'rule, word, fix, kind')}),
ps AS (SELECT doc_id, generate_subscripts(a, 1) AS k, unnest(a) AS original FROM (SELECT doc_id, regexp_extract_all(text, '{W}+|{NW}+') AS a FROM docs)), pl AS (SELECT doc_id, original, CAST(sum(length(original)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) - length(original) AS position FROM ps),
sp AS (SELECT doc_id, rule, original, CAST(sum(gap + length(original)) OVER (PARTITION BY doc_id, rule ORDER BY k) AS BIGINT) - length(original) AS position FROM ({_SPACED})),
al AS (SELECT doc_id, rule, kind, position, original, fix AS corrected FROM pl JOIN ru ON lower(original) = word UNION ALL SELECT doc_id, rule, 'Punctuation', position, original, regexp_replace(original, '^\s+([.!?,;:])\s*', '\1 ') FROM sp)
SELECT doc_id, rule, kind, position, original, corrected, {_AROUND} AS context FROM al JOIN docs USING (doc_id)""")
def grammar_changes(spark, sf_dir):
    return R.grammar_changes(papers(spark, sf_dir))


_TEXTS = [(" ", " "), ("[‘’]", "'"), ("[“”]", '"'), ("…", "..."), (r"(\d)\s*–\s*(\d)", r"\1-\2"), (r"\s*—\s*", ", "), (r"\s+–\s+", ", "), (r"[ \t]+\n", "\n")]


def _plain(x: str) -> str:
    for a, b in _TEXTS:
        x = f"regexp_replace({x}, {quoted(a)}, {quoted(b)}, 'g')"
    return x


_TYPOGRAPHIC = f"regexp_replace(array_to_string(list_transform(string_split(text, '`'), lambda v, i: CASE WHEN i % 2 = 1 THEN {_plain('v')} ELSE v END), '`'), '[ \\t]+$', '')"
_TRIMMED = rf"""CASE WHEN {words_sql('text')} <= 40 THEN trim(text) ELSE CASE WHEN array_to_string(tr.kept, ' ') = '' THEN array_to_string(string_split_regex(trim(text), '\s+')[1:40], ' ') ELSE array_to_string(tr.kept, ' ') END END"""


@query(rf"""WITH {P.DOCS}, a AS (SELECT doc_id, text, list_reduce(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda a, s: CASE WHEN a.stop OR a.n + {words_sql('s')} > 40 THEN {{'kept': a.kept, 'n': a.n, 'stop': true}} ELSE {{'kept': list_append(a.kept, s), 'n': a.n + {words_sql('s')}, 'stop': false}} END, {{'kept': []::VARCHAR[], 'n': 0::BIGINT, 'stop': false}}) AS tr FROM docs WHERE text IS NOT NULL)
SELECT doc_id, md5({_TYPOGRAPHIC}) AS typographic_md5, md5(regexp_replace(replace(text, '\"\"\"', ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS neutral_md5, md5({_TRIMMED}) AS trimmed_md5,
CASE WHEN instr(text, 'the') > 0 THEN CASE WHEN instr(text, 'the') > 51 THEN '...' ELSE '' END || substr(text, greatest(instr(text, 'the') - 50, 1), least(instr(text, 'the') - 1 + 53, length(text)) - greatest(instr(text, 'the') - 51, 0)) || CASE WHEN instr(text, 'the') - 1 + 53 < length(text) THEN '...' ELSE '' END END AS around FROM a""".replace('\\"', '"'))
def text_repairs(spark, sf_dir):
    """Typographic repair, neutralised delimiters, a cut to 40 words at a sentence's end, and the context of the first ``the``."""
    t, at = F.col("text"), F.instr("text", "the")
    rows = papers(spark, sf_dir).where("text is not null")
    return rows.select("doc_id", F.md5(T.typographic(t)).alias("typographic_md5"), F.md5(T.neutralise(t)).alias("neutral_md5"), F.md5(T.trim_to_words(t, 40)).alias("trimmed_md5"), F.when(at > 0, T.context(t, at - 1, F.lit(3))).alias("around"))


REPLIED = [(1, "```python\nx = 1\n```"), (2, "```\nplain\nlines\n```"), (3, "no fence"), (4, "## Results:\nThe body."), (5, "Results\nThe body."), (6, "Results of it\nThe body.")]


@query(rf"""SELECT conv_id, turn, md5(CASE WHEN regexp_matches(trim(raw), '(?s)^```[A-Za-z0-9_-]*\s*\n.*```$') THEN regexp_extract(trim(raw), '(?s)^```[A-Za-z0-9_-]*\s*\n(.*?)\n?```$', 1) ELSE trim(raw) END) AS bare_md5,
md5(CASE WHEN {heading_sql("string_split(ltrim(raw), chr(10))[1]")} = 'results' THEN trim(substr(ltrim(raw), length(string_split(ltrim(raw), chr(10))[1]) + 2)) ELSE raw END) AS body_md5 FROM {_REPLIES(REPLIED)}""")
def reply_repairs(spark, sf_dir):
    rows = replies(spark, sf_dir, REPLIED)
    return rows.select("conv_id", "turn", F.md5(T.strip_fence(F.col("raw"))).alias("bare_md5"), F.md5(T.drop_echoed_heading(F.col("raw"), F.lit("Results"))).alias("body_md5"))


@query(f"WITH {P.DOCS}, a AS (SELECT doc_id, coalesce(lower(text), '') AS lo FROM docs) SELECT doc_id, {', '.join(f'{_present(ws)} <> {P.literal(str())} AS {k}' for k, ws in L.INTENTS.items())} FROM a")
def conditional_intents(spark, sf_dir):
    return R.intents(papers(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit(""))))


# statistics and cases

@query("SELECT lang, source, count(*) AS docs, count(quality) AS labelled, round(avg(n_chars), 6) AS mean_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())")
def dataset_statistics(spark, sf_dir):
    from inkwell.operators.corpus import dataset_statistics as f

    return f(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("SELECT c.doc_id, variation, CASE variation WHEN 'exact_copy' THEN 1.0 WHEN 'paraphrased' THEN 0.7 WHEN 'similar_topic' THEN 0.4 ELSE 0.1 END::DOUBLE AS expected, md5(CASE variation WHEN 'exact_copy' THEN left(text, 500) WHEN 'paraphrased' THEN " + _nested_replace("left(text, 500)") + " WHEN 'similar_topic' THEN 'A related text about: ' || left(text, 80) ELSE 'An unrelated text about gardening and weather.' END) AS case_md5 FROM documents c, (VALUES ('exact_copy'), ('paraphrased'), ('similar_topic'), ('different_topic')) v(variation) WHERE length(text) >= 50")
def plagiarism_cases(spark, sf_dir):
    from inkwell.operators.corpus import plagiarism_cases as f

    return f(table(spark, sf_dir, "documents"), PARAPHRASES).select("doc_id", "variation", "expected", F.md5("case").alias("case_md5"))


@query()
def quality_regression(spark, sf_dir):
    from inkwell.operators.models import score_with_labels

    return score_with_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def language_forest(spark, sf_dir):
    from inkwell.operators.models import forest_accuracy

    return forest_accuracy(table(spark, sf_dir, "documents"), "lang")


_GATES = {"ai_style": "w < 25 OR len(lens) < 2", "tone": "n < 20", "cohesion": "CASE WHEN bl < 2 THEN li ELSE bl END < 2", "repetition": "len(list_filter(lens, lambda x: x >= 8)) < 2"}
_LONG = lambda split: f"len(list_filter({split}, lambda p: {words_sql('p')} >= 5))"


@query(rf"""WITH {P.DOCS}, c AS (SELECT doc_id, coalesce(text, '') AS t FROM docs), a AS (SELECT doc_id, {words_sql('t')} AS n, len(list_filter(regexp_extract_all(lower(t), '{TOKEN}'), lambda w: regexp_matches(w, '[a-z]'))) AS w,
list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {words_sql('s')}), lambda x: x > 0) AS lens, {_LONG(r"string_split_regex(trim(t), '\n\s*\n')")} AS bl, {_LONG("string_split(trim(t), chr(10))")} AS li FROM c)
{' UNION ALL '.join(f"SELECT doc_id, {P.literal(k)} AS analysis, {P.literal(Y.GATES[k])} AS error FROM a WHERE {g}" for k, g in _GATES.items())}""")
def applicability_errors(spark, sf_dir):
    return Y.gate_errors(papers(spark, sf_dir))


@query(f"""WITH un AS (SELECT text FROM benchmark UNION SELECT text FROM documents), nu AS (SELECT row_number() OVER () AS item_id, text FROM un), {_clean_cte('cp', 'nu', 'item_id')}
SELECT (SELECT count(*) FROM un) AS documents, (SELECT count(*) FROM cp) AS sentences""")
def corpus_summary(spark, sf_dir):
    """Size of the reference corpus with all documents added, repeats dropped."""
    from inkwell.operators.corpus import reference_corpus

    both = reference_corpus(table(spark, sf_dir, "documents").select("text"), table(spark, sf_dir, "benchmark").select("text"), distinct=True)
    return S.corpus_statistics(both.withColumn("item_id", F.monotonically_increasing_id()))


@query("SELECT label, vec_id, CASE WHEN vec_id % 3 > 0 THEN round(embedding[1]::DOUBLE, 6) END AS similarity, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN vec_id % 3 > 0 THEN round(embedding[1]::DOUBLE, 6) END DESC NULLS LAST, vec_id) AS rank FROM embeddings")
def reranked_items(spark, sf_dir):
    """Items of each label by a similarity that a third of them lack."""
    v = table(spark, sf_dir, "embeddings")
    items = v.select("label", "vec_id", F.when(F.col("vec_id") % 3 > 0, F.round(F.col("embedding")[0].cast("double"), 6)).alias("similarity"), F.col("vec_id").alias("place"))
    return S.rerank(items, ["label"], "vec_id").drop("place")


_NEUTRAL = lambda c: rf"regexp_replace(replace({c}, '" + '"' * 3 + r"', ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"


@query("WITH " + P.DOCS + ", i AS (SELECT * FROM " + P.values([(i, w, c) for i, (w, c) in enumerate(L.RUBRIC)], "i, weight, content") + """) SELECT doc_id, i AS item, weight::DOUBLE AS weight, md5('Judge the paper by one criterion.' || chr(10) || 'Criterion: ' || content || chr(10) || 'Answer as JSON with "reasoning", "score" (0 to 100), "evidence", "location", "severity" and "fix".' || chr(10) || '\"\"\"' || chr(10) || substr(""" + _NEUTRAL("text") + """, 1, 12000) || chr(10) || '\"\"\"') AS prompt_md5 FROM docs, i""")
def judge_prompts(spark, sf_dir):
    from inkwell.operators.prompts import judging_prompts

    return judging_prompts(papers(spark, sf_dir)).select("doc_id", F.col("index").alias("item"), "weight", F.md5("prompt").alias("prompt_md5"))


@query("WITH " + P.DOCS + ", m AS (SELECT unnest(" + listed(list(K.REWRITE_MODES)) + ") AS mode) SELECT doc_id, mode, md5('Task: ' || mode || '. Keep the meaning. Answer with the new text only.' || chr(10) || chr(10) || 'Text:' || chr(10) || " + _NEUTRAL("trim(text)") + ") AS prompt_md5 FROM docs, m")
def rewrite_prompts(spark, sf_dir):
    from inkwell.operators.prompts import rewrite_prompt

    each = F.array(*[F.struct(F.lit(m).alias("mode"), F.md5(rewrite_prompt(F.col("text"), m)).alias("prompt_md5")) for m in K.REWRITE_MODES])
    return papers(spark, sf_dir).select("doc_id", F.explode(each).alias("p")).select("doc_id", "p.*")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, opens DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS events FROM n GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    from inkwell.streaming.incremental import sessions

    found = sessions(table(spark, sf_dir, "events").where("user_id is not null and ts is not null"), "user_id")
    return found.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "events")


_JUDGED = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains(" + listed(L.REFERENCE_STOP_WORDS) + ", w)))"


@query(rf"""WITH {P.DOCS}, c AS (SELECT i, weight, {_JUDGED.format('content')} AS want FROM {P.values([(i, w, c) for i, (w, c) in enumerate(L.RUBRIC)], 'i, weight, content')}),
t AS (SELECT doc_id, {_JUDGED.format("substr(text, 1, 12000)")} AS have FROM docs WHERE trim(coalesce(text, '')) <> ''),
s AS (SELECT doc_id, weight, (100 * len(list_filter(want, lambda w: list_contains(have, w)))) // greatest(1, len(want)) AS score FROM t, c)
SELECT doc_id, round(sum(score * weight::DOUBLE) / sum(weight::DOUBLE), 6) AS total, count(*) AS scored, 0 AS skipped FROM s GROUP BY doc_id""")
def review_totals(spark, sf_dir):
    """Each document scored by the default rubric with the offline judge, from prompts to weighted totals."""
    from inkwell.operators import review as E
    from inkwell.sources.providers import WordJudge

    docs = papers(spark, sf_dir)
    items = E.score_items(docs, E.rubrics(docs), WordJudge())
    return E.totals(items).select("doc_id", "total", "scored", "skipped")


@query()
def prompt_repairs(spark, sf_dir):
    """User turns and documents, taken as prompts, repaired offline: passes, what is left of banned terms, and the text's digest."""
    from inkwell.operators import review as E
    from inkwell.sources.providers import Scrubber

    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("id"), F.col("text").alias("prompt"))
    rows = turns.unionByName(papers(spark, sf_dir).select(F.concat_ws("-", F.lit("doc"), "doc_id").alias("id"), F.col("text").alias("prompt")))
    return E.repaired(rows, Scrubber()).select("id", F.md5("prompt").alias("prompt_md5"), F.col("passes").cast("long").alias("passes"), "residual", "warning")


_DENSITIES = ", ".join(f"CASE WHEN n = 0 THEN 0 ELSE round({_HITS(ws)}::DOUBLE / n, 6) END AS {k}_density" for k, ws in K.TOPIC_TYPES.items())


@query(f"WITH {P.DOCS}, {_LOW}, a AS (SELECT doc_id, lo, {words_sql('lo')} AS n FROM lw) SELECT doc_id, {_DENSITIES} FROM a")
def topic_keyword_densities(spark, sf_dir):
    return V.keyword_densities(papers(spark, sf_dir))


@query()
def forest_fold_accuracies(spark, sf_dir):
    """Languages by forests of 200 trees on a counted vocabulary of 1- to 3-word terms: rows and hits of each label in each stratified fold."""
    from inkwell.operators.models import fold_accuracies

    return fold_accuracies(table(spark, sf_dir, "documents").select("doc_id", "text", "lang").where("text IS NOT NULL"), "lang", folds=3)
