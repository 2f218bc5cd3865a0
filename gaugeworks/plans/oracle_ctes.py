"""DuckDB counterparts of the derived inputs, as common table expressions."""

WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

TOK = rf"""tdocs AS (SELECT doc_id, lang, {WORDS} AS toks FROM documents),
trows AS (SELECT doc_id, lang, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM tdocs),
tpair AS (SELECT lang, tok, count(*) AS c FROM trows GROUP BY lang, tok),
tmodel AS (SELECT lang, tok, ln(c / sum(c) OVER (PARTITION BY lang)) AS ll, ln(sum(c) OVER (PARTITION BY tok) / sum(c) OVER ()) AS lm FROM tpair),
tok AS (SELECT doc_id, r.lang, pos, r.tok, ll, lm, -ll * exp(ll) AS ent, count(*) OVER (PARTITION BY doc_id) AS n FROM trows r JOIN tmodel m ON r.lang = m.lang AND r.tok = m.tok)"""

DIST = """demb AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
dlse AS (SELECT *, ln(list_sum(list_transform(e, lambda x: exp(x)))) AS z FROM demb),
dist AS (SELECT vec_id, label, list_transform(e, lambda x: x - z) AS lp, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS token_idx FROM dlse),
cell AS (SELECT vec_id, label, token_idx, unnest(lp) AS l, unnest(range(len(lp))) AS k FROM dist)"""

SAMP = rf"""sdocs AS (SELECT conv_id, turn, role, text, {WORDS} AS toks FROM conversations),
srows AS (SELECT conv_id, turn, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM sdocs),
smodel AS (SELECT tok, ln(count(*) / (SELECT count(*) FROM srows)) AS ll FROM srows GROUP BY tok),
stok AS (SELECT conv_id, turn, pos, r.tok, ll FROM srows r JOIN smodel m ON r.tok = m.tok),
samp AS (SELECT conv_id, turn, sum(ll) AS logprob, count(*) AS len FROM stok GROUP BY conv_id, turn)"""

_SIM = """CASE WHEN i = j THEN 1.0 ELSE least(1.0, 10 * jac) END AS entail"""
PAIR = rf"""pset AS (SELECT conv_id, turn, list_distinct({WORDS}) AS t FROM conversations),
pjac AS (SELECT a.conv_id, a.turn AS i, b.turn AS j, CASE WHEN len(a.t) + len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END AS jac FROM pset a JOIN pset b ON a.conv_id = b.conv_id),
pent AS (SELECT *, {_SIM} FROM pjac),
pair AS (SELECT *, (1 - entail) / 2 AS contra, ln(entail + 1e-6) AS e_logit, ln((1 - entail) / 2 + 1e-6) AS c_logit, CASE WHEN i = j OR jac >= 0.055 THEN 2 WHEN jac < 0.025 THEN 0 ELSE 1 END AS cls FROM pent),
psize AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)"""

CLAIM = rf"""clines AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {{'text': x, 'n': len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> ''))}}), lambda x: x.n > 0) AS l FROM documents),
crows AS (SELECT doc_id, unnest(l) AS c, unnest(range(len(l))) AS claim_idx FROM clines),
claim AS (SELECT doc_id, claim_idx, c.text AS text, c.n AS n, coalesce(sum(c.n) OVER (PARTITION BY doc_id ORDER BY claim_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first,
  CASE WHEN (doc_id + claim_idx) % 11 = 0 THEN NULL WHEN (doc_id + claim_idx) % 7 = 0 THEN 1.0 ELSE 0.0 END AS verified FROM crows)"""

CAND = """cand AS (SELECT l_orderkey AS question_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS cand_idx,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS annotation, l_discount AS discount, l_tax AS tax, -l_extendedprice AS price FROM lineitem)"""

TRAJ = """traj AS (SELECT 'run' || CAST(user_id % 3 AS VARCHAR) AS run, user_id, CAST(ts AS DATE) AS day, list(event_type ORDER BY ts, event_id) AS steps, list(value / 500 ORDER BY ts, event_id) AS step_scores,
  bool_or(event_type = 'purchase') AS completed, bool_or(event_type = 'error') AS failed FROM events GROUP BY user_id, CAST(ts AS DATE))"""

ENS = DIST + """,
ens AS (SELECT label AS obs, vec_id % 4 AS model, row_number() OVER (PARTITION BY label, vec_id % 4 ORDER BY vec_id) - 1 AS token_idx, lp FROM dist),
ecell AS (SELECT obs, model, token_idx, unnest(lp) AS l, unnest(range(len(lp))) AS k FROM ens)"""

ANS = """ans AS (SELECT d.doc_id AS unit, d.lang, ln(d.n_chars) AS ue, CAST(quality AS DOUBLE) AS target, CAST(toxic AS DOUBLE) AS toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

REW = CLAIM + r""",
crew AS (SELECT *, 1 / (1 + exp(-(length(text) - 40) / 20.0)) AS reward, coalesce(lag(text) OVER (PARTITION BY doc_id ORDER BY claim_idx), '') AS prev FROM claim),
cset AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(prev, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS b FROM crew),
rew AS (SELECT doc_id, claim_idx, text, verified, reward, reward AS validity, CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS redundancy FROM cset)"""


def rising(rows: str, x: str, y: str) -> str:
    """Distinct x with the rising fit of y: the largest, over starts up to x, of the least mean up to any end from x on."""
    return f"""icell AS (SELECT x, w, sy, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(sy) OVER (ORDER BY x) AS cy FROM (SELECT {x} AS x, count(*) AS w, sum({y}) AS sy FROM {rows} GROUP BY 1)),
imean AS (SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.sy) / (b.cw - a.cw + a.w) AS m FROM icell a JOIN icell b ON a.i <= b.i),
ileast AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM imean),
ifit AS (SELECT x, w, round(f, 12) AS fit FROM icell JOIN (SELECT i, max(m) AS f FROM ileast GROUP BY i) USING (i))"""


BINS = """bcell AS (SELECT ue, w, y, sum(w) OVER (ORDER BY ue) AS cum, sum(w) OVER () AS n FROM (SELECT ue, count(*) AS w, avg(target) AS y FROM {rows} GROUP BY ue)),
bedge AS (SELECT DISTINCT e FROM (SELECT min(ue) AS e FROM bcell UNION ALL SELECT max(ue) FROM bcell UNION ALL SELECT (SELECT min(ue) FROM bcell WHERE cum >= k * n / 10.0) FROM (SELECT unnest(range(1, 10)) AS k, (SELECT max(n) FROM bcell) AS n))),
bplace AS (SELECT ue, w, y, greatest(0, (SELECT count(*) FROM bedge WHERE e < ue) - 1) AS bin FROM bcell),
bmean AS (SELECT edges.bin, edges.e AS lo, edges.hi, coalesce(m, 0) AS m FROM (SELECT e, lead(e) OVER (ORDER BY e) AS hi, row_number() OVER (ORDER BY e) - 1 AS bin FROM bedge) edges LEFT JOIN (SELECT bin, sum(w * y) / sum(w) AS m FROM bplace GROUP BY bin) b ON b.bin = edges.bin WHERE edges.hi IS NOT NULL)"""
