"""SQL (DuckDB) that states the same results as operators that SQL can express."""

from __future__ import annotations

from inkwell.llm import linedup, lm, mixing

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _components(nodes: str, node: str, links: str) -> str:
    """``comp(id, component)`` of ``nodes`` over ``links(a, b)`` in both directions."""
    return f"reach(id, other) AS (SELECT {node}, {node} FROM {nodes} UNION SELECT reach.id, links.b FROM reach JOIN {links} AS links ON links.a = reach.other), comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"


_N = linedup.NEAR_CHARS
LINES = rf"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
e AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS k, row_number() OVER (ORDER BY doc_id, line_no) AS place FROM e),
u AS (SELECT line, place, length(line) AS n FROM r WHERE k = 1 AND length(line) >= {_N}),
h AS (SELECT place, line, n AS size, 0 AS role, 'f' AS side, left(line, n // 2) AS part FROM u UNION ALL SELECT place, line, n, 0, 'l', right(line, n - n // 2) FROM u
UNION ALL SELECT place, line, n - 1, 1, 'f', left(line, (n - 1) // 2) FROM u UNION ALL SELECT place, line, n - 1, 1, 'l', right(line, n - 1 - (n - 1) // 2) FROM u),
p AS (SELECT DISTINCT x.place AS a, x.line AS la, y.place AS b, y.line AS lb FROM h x JOIN h y ON x.size = y.size AND x.side = y.side AND x.part = y.part AND x.role = 0 AND x.place <> y.place),
q AS (SELECT greatest(a, b) AS place FROM p WHERE levenshtein(la, lb) = 1)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, k = 1 AND r.place NOT IN (SELECT place FROM q) AS kept, CASE WHEN k > 1 THEN 'exact' WHEN r.place IN (SELECT place FROM q) THEN 'near' END AS reason FROM r"""

_HASH = lambda *parts: f"CAST('0x' || substr(md5('{mixing.SEED}' || " + " || ".join(f"'|' || {p}" for p in parts) + "), 1, 15) AS BIGINT)"
_CURVE = lambda a: f"ln(list_sum([pow(x, {a}) for x in ps])) - list_sum([pow(x, {a}) * {a} * ln(x) for x in ps]) / list_sum([pow(x, {a}) for x in ps])"
_FITS = lambda a: f"({_CURVE(a)} <= target + 1e-12 AND list_max([pow(x, {a}) / x for x in ps]) / list_sum([pow(x, {a}) for x in ps]) <= 4)"
_STEPS = 5 * mixing.PASSES
MIX = rf"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
so AS (SELECT s, CAST(sum(n_tokens) AS BIGINT) AS t, count(*) AS n FROM d GROUP BY s), tot AS (SELECT CAST(sum(t) AS BIGINT) AS total FROM so),
ps0 AS (SELECT list(t / total::DOUBLE) FILTER (WHERE t > 0) AS ps FROM so, tot), ps1 AS (SELECT ps, {_CURVE('1.0::DOUBLE')} + 0.5::DOUBLE * (ln(len(ps)) - ({_CURVE('1.0::DOUBLE')})) AS target FROM ps0),
bis(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, CASE WHEN (SELECT {_FITS('0.0::DOUBLE')} FROM ps1) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END UNION ALL SELECT i + 1, CASE WHEN {_FITS('((lo + hi) / 2)')} THEN lo ELSE (lo + hi) / 2 END, CASE WHEN {_FITS('((lo + hi) / 2)')} THEN (lo + hi) / 2 ELSE hi END FROM bis, ps1 WHERE i < {_STEPS} AND hi > 0),
al AS (SELECT hi AS a FROM bis ORDER BY i DESC LIMIT 1), pw AS (SELECT s, t, n, CASE WHEN t > 0 THEN pow(t / total::DOUBLE, a) ELSE 0 END AS p, total FROM so, tot, al),
q0 AS (SELECT s, t, CAST(ceil(sqrt(n)) AS BIGINT) AS blocks, p / sum(p) OVER () AS weight, total FROM pw), q1 AS (SELECT *, CAST(floor(weight * total + 1e-6) AS BIGINT) AS quota FROM q0),
q AS (SELECT *, CASE WHEN t > 0 THEN quota // t ELSE 1 END AS epochs, CASE WHEN t > 0 THEN quota % t ELSE 0 END AS rest FROM q1),
dk AS (SELECT d.*, q.weight, q.epochs, q.rest, q.blocks, {_HASH('d.s', 'q.epochs', "'row'", "coalesce(CAST(doc_id AS VARCHAR), '')")} AS key FROM d JOIN q ON d.s = q.s),
db AS (SELECT *, key % greatest(blocks, 1) AS blk FROM dk), dt AS (SELECT *, {_HASH('s', 'epochs', 'blk')} AS turn FROM db),
bl AS (SELECT s, blk, any_value(turn) AS turn, any_value(rest) AS rest, sum(n_tokens) AS size FROM dt WHERE rest > 0 GROUP BY s, blk), up AS (SELECT *, sum(size) OVER (PARTITION BY s ORDER BY turn, blk) AS upto FROM bl),
ed AS (SELECT s, blk AS edge, turn AS eturn, rest - upto + size AS room FROM up WHERE upto > rest QUALIFY row_number() OVER (PARTITION BY s ORDER BY turn, blk) = 1),
ik AS (SELECT dt.s, key, room, sum(n_tokens) OVER (PARTITION BY dt.s ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto FROM dt JOIN ed ON dt.s = ed.s AND dt.blk = ed.edge), lk AS (SELECT s, max(key) AS last_key FROM ik WHERE upto <= room GROUP BY s),
tm AS (SELECT dt.*, epochs + CASE WHEN rest > 0 AND coalesce(eturn IS NULL OR turn < eturn OR (turn = eturn AND blk < edge) OR (blk = edge AND key <= last_key), false) THEN 1 ELSE 0 END AS times FROM dt LEFT JOIN ed ON dt.s = ed.s LEFT JOIN lk ON dt.s = lk.s),
ex AS (SELECT doc_id, source, s, n_tokens, weight, blocks, unnest(range(times)) AS epoch FROM tm), ek AS (SELECT *, {_HASH('s', 'epoch', "'row'", "coalesce(CAST(doc_id AS VARCHAR), '')")} AS key FROM ex), eb AS (SELECT *, key % greatest(blocks, 1) AS block FROM ek)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, epoch, block, row_number() OVER (PARTITION BY s, epoch ORDER BY {_HASH('s', 'epoch', 'block')}, block, key, doc_id) AS position FROM eb"""

NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)), {_components('documents', 'doc_id', 'k')}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, doc_id = component AS kept FROM documents JOIN comp ON id = doc_id LEFT JOIN n USING (doc_id)"""

LM = rf"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), o AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w), o2 AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM o),
c1 AS (SELECT w, count(*) AS c FROM o GROUP BY w), m1 AS (SELECT doc_id, w, count(*) AS c FROM o GROUP BY ALL), c2 AS (SELECT v, w, count(*) AS c FROM o2 WHERE v IS NOT NULL GROUP BY ALL), m2 AS (SELECT doc_id, v, w, count(*) AS c FROM o2 WHERE v IS NOT NULL GROUP BY ALL),
z AS (SELECT o2.doc_id, o2.v, c1.c - m1.c AS uni, greatest((SELECT count(*) FROM o) - len(ws), 1) AS n, c2.c - m2.c AS bi, p1.c - q1.c AS ctx FROM o2 JOIN w USING (doc_id) JOIN c1 ON c1.w = o2.w JOIN m1 ON m1.doc_id = o2.doc_id AND m1.w = o2.w
LEFT JOIN c2 ON c2.v = o2.v AND c2.w = o2.w LEFT JOIN m2 ON m2.doc_id = o2.doc_id AND m2.v = o2.v AND m2.w = o2.w LEFT JOIN c1 p1 ON p1.w = o2.v LEFT JOIN m1 q1 ON q1.doc_id = o2.doc_id AND q1.w = o2.v),
s AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE v IS NOT NULL AND bi = 0) AS n_backoff, avg(CASE WHEN v IS NOT NULL AND bi > 0 THEN ln(bi) - ln(ctx) ELSE ln(greatest(uni, 1)) - ln(n) + CASE WHEN v IS NOT NULL THEN ln({lm.BACKOFF}) ELSE 0 END END) AS score FROM z GROUP BY doc_id)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_backoff, 0) AS n_backoff, round(score, 6) AS score FROM documents LEFT JOIN s USING (doc_id)"""

VECTORS = f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), g AS (SELECT * FROM e WHERE len(x) > 0 AND list_count(x) = len(x) AND list_bool_and([isfinite(c) for c in x]) AND list_max([abs(c) for c in x]) > 0),
k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95), {_components('e', 'vec_id', 'k')}, n AS (SELECT a, count(*) AS n FROM k GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component AS component_id, vec_id = component AS kept FROM e JOIN comp ON id = vec_id LEFT JOIN n ON a = vec_id"""

SQL = {"op1_linededup": LINES, "op2_mixing": MIX, "op4_minhash": NEAR, "op5_lm": LM, "op6_rabitq": VECTORS}
