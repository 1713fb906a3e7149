"""The same results as the catalogue in DuckDB SQL, written without its operators."""

from __future__ import annotations

import itertools

from ..functions.text import LEADING, MID_AFTER, ORDINALS, REASON, REWRITE, REWRITE_SYSTEM, SEQUENTIAL, SPEC, STOPWORDS, TASK
from . import fixtures as fx


def q(text: str) -> str:
    """A SQL string literal; line feeds as chr(10)."""
    return "(" + " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n")) + ")"


PERM = """perm AS (SELECT CAST(row_number() OVER (ORDER BY a, b, c, d) - 1 AS BIGINT) AS idx, [a, b, c, d] AS r, '[' || a || ', ' || b || ', ' || c || ', ' || d || ']' AS key
FROM range(1, 5) x(a), range(1, 5) y(b), range(1, 5) z(c), range(1, 5) w(d) WHERE a <> b AND a <> c AND a <> d AND b <> c AND b <> d AND c <> d)"""
EV = f"ev AS (SELECT event_id // 4 AS id, event_id % 4 AS view, user_id, {fx.KIND} AS kind FROM events)"
TR = f"tr AS MATERIALIZED (SELECT id, {fx.TRUTH_AT} AS truth_at, id % 13 < 2 AS no_ordering, CASE WHEN id % 10 < 3 THEN 'val' ELSE 'test' END AS fold FROM (SELECT DISTINCT id FROM ev))"
VT = f"vt AS (SELECT ev.id, view, kind, CASE WHEN kind = 'orderable' THEN {fx.VOTE_AT} END AS ix FROM ev JOIN tr ON ev.id = tr.id)"
BASE = f"WITH RECURSIVE {PERM}, {EV}, {TR}, {VT}"


def md5_int(text: str) -> str:
    return f"(('0x' || substring(md5({text}), 1, 8))::BIGINT)"


def dec(ban: bool = False, gate: bool = True, quota: int = 0, name: str = "d") -> str:
    far = " + ".join(f"(n_ord * r[{i}] - s{i}) * (n_ord * r[{i}] - s{i})" for i in range(1, 5))
    cases = "WHEN n_votes = n_fail THEN 'parse_fail' WHEN 2 * n_un > n_votes - n_fail THEN 'unorderable_majority'"
    cases += f" WHEN n_id >= {quota} THEN 'identity_quota'" if quota else ""
    cases += " WHEN top IS NULL THEN 'all_identity_votes'" if ban else ""
    cases += " WHEN coalesce(top, 0) <= 1 THEN 'disperse_gate'" if gate else ""
    return f"""g AS (SELECT id, count(*) AS n_votes, count(*) FILTER (kind = 'fail') AS n_fail, count(*) FILTER (kind = 'unorderable') AS n_un, count(*) FILTER (ix = 0) AS n_id, count(ix) AS n_ord FROM vt GROUP BY id),
c AS (SELECT id, ix, count(*) AS cnt FROM vt WHERE ix IS NOT NULL GROUP BY id, ix),
m AS (SELECT id, {', '.join(f'sum(cnt * r[{i}]) AS s{i}' for i in range(1, 5))}, max(cnt) AS consensus FROM c JOIN perm ON ix = idx GROUP BY id),
b AS (SELECT c.id, ix, cnt, row_number() OVER (PARTITION BY c.id ORDER BY cnt DESC, {far}, ix) AS rn, max(cnt) OVER (PARTITION BY c.id) AS mx FROM c JOIN perm ON ix = idx JOIN m ON m.id = c.id JOIN g ON g.id = c.id {'WHERE ix <> 0' if ban else ''}),
t AS (SELECT id, max(mx) AS top, count(*) FILTER (cnt = mx) AS modes, max(ix) FILTER (rn = 1) AS best FROM b GROUP BY id),
w AS (SELECT g.*, coalesce(consensus, 0) AS consensus, best, CASE {cases} WHEN modes = 1 THEN 'mode' ELSE 'borda_tie' END AS reason FROM g LEFT JOIN t USING (id) LEFT JOIN m USING (id)),
{name} AS (SELECT id, n_votes, n_fail, n_un, n_id, n_ord, consensus, reason, CASE WHEN reason IN ('mode', 'borda_tie') THEN best ELSE 0 END AS ix FROM w)"""


TAU = " + ".join(f"CASE WHEN (p.r[{i}] - p.r[{j}]) * (u.r[{i}] - u.r[{j}]) > 0 THEN 1 ELSE -1 END" for i in range(1, 5) for j in range(i + 1, 5))
SC = f"s AS (SELECT d.id, d.ix, d.consensus, d.reason, truth_at, no_ordering, fold, CAST(d.ix = truth_at AS INTEGER) AS em, ({TAU}) / 6.0::DOUBLE AS tau FROM d JOIN tr ON tr.id = d.id JOIN perm p ON p.idx = d.ix JOIN perm u ON u.idx = truth_at)"
SCORED = f"{BASE}, {dec()}, {SC}"

LL = f"""ll AS (SELECT id, truth_at, no_ordering, a.ix AS ix,
  -({md5_int("'ll:' || tr.id || ':' || a.ix")} % 5000) / 100.0::DOUBLE AS base FROM tr, range(25) a(ix) WHERE id % 29 <> 5),
ls AS MATERIALIZED (SELECT id, ix, CASE WHEN ix < 24 THEN (base + CASE WHEN ix = truth_at THEN 12.0::DOUBLE ELSE 0.0 END) / 20
  ELSE (base * 0.6::DOUBLE + CASE WHEN no_ordering THEN 12.0::DOUBLE ELSE 0.0 END) / 12 END AS score FROM ll),
sl AS MATERIALIZED (SELECT id, list(score ORDER BY ix) AS s FROM ls GROUP BY id)"""

#: The 24 answers in order, so that an index needs no join.
KEYS = "[" + ", ".join("'[" + ", ".join(map(str, p)) + "]'" for p in itertools.permutations(range(1, 5))) + "]"


def key(ix: str) -> str:
    return f"({KEYS})[1 + ({ix})]"


def best(name: str, ban: bool = False, voted: bool = False) -> str:
    """(id, ix, best, unord): the first greatest allowed score of every sample, from its list of scores."""
    every = f"list_filter(range(24), lambda i: i >= {int(ban)})"
    only = f"list_filter(range(24), lambda i: i >= {int(ban)} AND list_contains(vx, i))"
    some = "list_filter(range(24), lambda i: list_contains(vx, i))"
    kept = f"CASE WHEN len({only}) > 0 THEN {only} WHEN len({some}) > 0 THEN {some} ELSE {every} END" if voted else every
    votes = "LEFT JOIN (SELECT id, list(ix) AS vx FROM c GROUP BY id) v ON v.id = sl.id" if voted else ""
    return f"""{name} AS MATERIALIZED (SELECT id, best, s[25] AS unord, list_min(list_filter(kept, lambda i: s[1 + i] = best)) AS ix
  FROM (SELECT *, list_max(list_transform(kept, lambda i: s[1 + i])) AS best FROM (SELECT sl.id, s, {kept} AS kept FROM sl {votes})))"""


def events_of(x: str) -> str:
    after, before = ("(?is)" + LEADING % w for w in ("after", "before"))
    segs = f"CASE WHEN regexp_matches({x}, '{after}') THEN [regexp_extract({x}, '{after}', 1), regexp_extract({x}, '{after}', 2)] WHEN regexp_matches({x}, '{before}') THEN [regexp_extract({x}, '{before}', 2), regexp_extract({x}, '{before}', 1)] ELSE [{x}] END"
    chunks = f"flatten(list_transform({segs}, lambda a: regexp_split_to_array(a, '(?i){SEQUENTIAL}')))"
    clauses = f"flatten(list_transform({chunks}, lambda a: list_reverse(regexp_split_to_array(a, '(?i){MID_AFTER}'))))"
    return f"list_filter(list_transform({clauses}, lambda a: trim(regexp_replace(a, '^[ ,.;]+|[ ,.;]+$', '', 'g'))), lambda a: a <> '')"


CAP = f"""cap AS (SELECT p_partkey AS id, p_partkey AS k, p_name, p_type, p_brand, {fx.CAPTION.replace('k %', 'p_partkey %')} AS caption FROM part),
cx AS (SELECT cap.*, {events_of('caption')} AS events, {fx.TRUTH_AT} AS truth_at, id % 13 < 2 AS no_ordering FROM cap),
ca AS (SELECT cx.*, r, list_transform([1, 2, 3, 4], lambda i: list_position(r, i)) AS o, key FROM cx JOIN perm ON idx = truth_at)"""
REFUSE = "'Conclusion: UNORDERABLE' || chr(10) || 'Answer: [1, 2, 3, 4]'"
ORD = "[" + ", ".join(f"'{o}'" for o in ORDINALS) + "]"
ANSWER = "'Conclusion: ORDERABLE' || chr(10) || 'Answer: ' || key"
STEP1 = "'Step 1 - Events described in the caption, in temporal order:' || chr(10) || array_to_string(list_transform(events, lambda e, i: '  E' || i || '. ' || e), chr(10)) || chr(10)"
NOTE = "CASE WHEN len(events) = 4 THEN ' (E' || i || ')' ELSE '' END"
COT = f"""CASE WHEN no_ordering THEN {STEP1} || {q('Step 2 - ' + REASON)} || chr(10) || {REFUSE} ELSE {STEP1} || 'Step 2 - Matching frames to the timeline:' || chr(10)
|| array_to_string(list_transform(o, lambda f, i: '  ' || ({ORD})[i] || ' in time: Frame ' || f || {NOTE}), chr(10)) || chr(10)
|| 'Step 3 - Temporal position of each frame: ' || array_to_string(list_transform(r, lambda x, i: 'Frame ' || i || ' -> ' || ({ORD})[x]), ', ') || chr(10) || {ANSWER} END"""
MID = f"CASE WHEN no_ordering THEN {REFUSE} ELSE 'Order: ' || array_to_string(list_transform(o, lambda f: 'Frame ' || f), ' -> ') || chr(10) || {ANSWER} END"
SHORT = f"CASE WHEN no_ordering THEN {REFUSE} ELSE {ANSWER} END"
PROMPT = f"{q(REWRITE[0])} || caption || {q(REWRITE[1])} || array_to_string(list_transform(events, lambda e, i: i || '. ' || e), chr(10)) || {q(REWRITE[2])} || '3' || {q(REWRITE[3])}"


def fin(x: str) -> str:
    return f"(CASE WHEN regexp_matches(trim({x}), '[.!?]$') THEN trim({x}) ELSE trim({x}) || '.' END)"


INIT, LAST = "array_to_string(events[1:len(events) - 1], ', then ')", "events[len(events)]"
MORE = "CASE WHEN len(events) > 2 THEN ', then ' || array_to_string(events[3:], ', then ') ELSE '' END"
TEMPLATES = [fin(t) for t in ("array_to_string(events, ', then ')", "array_to_string(events, ', followed by ')", f"({INIT} || ', finally ' || {LAST})", f"(events[1] || ' before ' || events[2] || {MORE})", f"(events[2] || ' after ' || events[1] || {MORE})", f"({INIT} || ', ending with ' || {LAST})")]
VARIANTS = f"""cv AS (SELECT id, n, v FROM (SELECT id, caption, events, unnest([{', '.join(TEMPLATES)}]) AS v, unnest(range(6)) AS n FROM ca WHERE len(events) >= 2) WHERE v <> trim(caption) AND {events_of('v')} = events),
vd AS (SELECT id, v, min(n) AS n FROM cv GROUP BY id, v),
vl AS (SELECT ca.id, caption, coalesce(l, []) AS l FROM ca LEFT JOIN (SELECT id, list(v ORDER BY n) AS l FROM vd GROUP BY id) x ON x.id = ca.id)"""
CONTENT = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in STOPWORDS) + "], t)))"

HARD = f"""h0 AS (SELECT s.id, s.no_ordering, s.ix, s.truth_at, s.tau, {{missing}} AS lost FROM s),
h1 AS (SELECT id, no_ordering, ix, truth_at, lost, NOT lost AND ix = truth_at AS em, CASE WHEN lost THEN -1.0::DOUBLE ELSE tau END AS tau FROM h0),
h AS (SELECT *, CASE WHEN lost THEN 1.0::DOUBLE WHEN em THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.5::DOUBLE, (1 - tau) / 2, CASE WHEN no_ordering AND ix <> 0 THEN 0.9::DOUBLE WHEN NOT no_ordering AND ix = 0 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END)) END AS score FROM h1)"""
HARD_ALL, HARD_31 = HARD.format(missing="false"), HARD.format(missing="s.id % 31 = 0")

HEAD = r"""hd AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents),
tk AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM hd),
tf AS (SELECT id, term, count(*) AS tf FROM tk GROUP BY id, term)"""
TFIDF = HEAD + """, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wx AS (SELECT id, tf.term, tf * (ln((1 + (SELECT count(*) FROM hd)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term)),
wn AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM wx),
pr AS (SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS sim FROM wn a JOIN wn b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id HAVING round(sum(a.w * b.w), 6) >= 0.8)"""
CLASSES = r"""bg AS (SELECT id, array_to_string(list_sort(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')), ' ') AS bag FROM hd),
cl AS (SELECT id, CASE WHEN bag = '' THEN id ELSE min(id) OVER (PARTITION BY bag) END AS rep FROM bg)"""
KNN = TFIDF[: TFIDF.index(",\npr AS")] + """, ks AS (SELECT a.id, b.id AS mate, round(sum(a.w * b.w), 6) AS sim FROM wn a JOIN wn b ON a.term = b.term AND a.id % 20 = 0 AND a.id <> b.id GROUP BY a.id, b.id),
kn AS (SELECT id, mate, sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC, mate) AS rank FROM ks)"""
GROUPS = TFIDF + """, ed AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr),
rc AS (SELECT a AS id, b AS o FROM ed UNION SELECT rc.id, ed.b FROM rc JOIN ed ON rc.o = ed.a),
gr AS (SELECT hd.id, least(hd.id, coalesce(m, hd.id)) AS grp FROM hd LEFT JOIN (SELECT id, min(o) AS m FROM rc GROUP BY id) x ON x.id = hd.id)"""
SPLIT = GROUPS + f""", gs AS (SELECT grp, count(*) AS size, {md5_int("'42:' || grp")} AS hh FROM gr GROUP BY grp),
gf AS (SELECT grp, CASE WHEN sum(size) OVER (ORDER BY hh, grp) - size < floor((SELECT count(*) FROM gr) * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS fold FROM gs),
sp AS (SELECT gr.id, gr.grp, fold FROM gr JOIN gf ON gf.grp = gr.grp)"""
NEAR = HEAD + """, dt AS (SELECT term, count(*) AS df FROM tf WHERE id % 10 <> 0 GROUP BY term),
wx AS (SELECT id, tf.term, tf * (ln((1 + (SELECT count(*) FROM hd WHERE id % 10 <> 0)) / (1 + df)) + 1) AS x FROM tf JOIN dt USING (term)),
wn AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM wx),
ns AS (SELECT a.id, b.id AS o, sum(a.w * b.w) AS s FROM wn a JOIN wn b ON a.term = b.term AND a.id % 10 = 0 AND b.id % 10 <> 0 GROUP BY a.id, b.id),
nn AS (SELECT hd.id, round(coalesce(max(s), 0.0), 6) AS sim FROM hd LEFT JOIN ns ON ns.id = hd.id WHERE hd.id % 10 = 0 GROUP BY hd.id)"""

LOGITS = f"""lv AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * 8) AS v, {fx.TRUTH_AT.replace('id', 'vec_id')} AS target FROM embeddings),
lg AS (SELECT id, target, 1 / (1 + exp(-v[17])) AS gate, unnest(range(4)) AS f, v FROM lv),
lr AS (SELECT id, target, gate, f, v[1 + 4 * f:4 + 4 * f] AS row FROM lg),
lz AS (SELECT *, ln(list_sum(list_transform(row, lambda x: exp(x)))) AS z FROM lr),
ps AS (SELECT id, target, gate, idx AS ix, sum(row[r[f + 1]] - z) AS score FROM lz, perm GROUP BY id, target, gate, idx)"""
HITS = """bb AS (SELECT id, any_value(gate) AS gate, any_value(target) AS target, arg_max(ix, (round(score, 12), -ix)) AS best, arg_max(ix, (round(score, 12), -ix)) FILTER (ix > 0) AS banned FROM ps GROUP BY id),
taus AS (SELECT round(i * 0.02::DOUBLE, 2) AS tau FROM range(51) x(i) UNION ALL SELECT 1.1::DOUBLE),
cu AS (SELECT tau, avg(CASE WHEN gate > tau THEN (target = 0)::INT ELSE (banned = target)::INT END) AS em, avg(CASE WHEN gate > tau THEN (target = 0)::INT ELSE (best = target)::INT END) AS em_free FROM bb, taus GROUP BY tau)"""
EMB = """e8 AS (SELECT g.id, slot, coalesce(embedding::DOUBLE[], list_transform(range(64), lambda i: 0.0::DOUBLE)) AS e
  FROM (SELECT DISTINCT vec_id // 8 AS id FROM embeddings) g CROSS JOIN range(8) y(slot) LEFT JOIN embeddings ON vec_id = g.id * 8 + slot),
dp AS (SELECT a.id, a.slot AS i, b.slot AS j, list_dot_product(a.e, b.e) AS s FROM e8 a JOIN e8 b ON a.id = b.id AND a.slot < 4 AND a.slot <> b.slot)"""
GRAY = """gp AS (SELECT p_partkey AS id, r, c, CASE WHEN r < p_partkey % 9 OR r >= 24 - p_partkey % 5 THEN 2 WHEN p_partkey % 3 = 0 THEN 30 + (r + c) % 4 ELSE (r * 37 + c * 11 + p_partkey * 7) % 256 END AS v FROM part, range(24) x(r), range(32) y(c))"""
GST = GRAY + """, ge AS (SELECT id, -sum(p * log2(p)) AS entropy FROM (SELECT id, count(*) / 768 AS p FROM gp GROUP BY id, least(floor(v * 64 / 255.0::DOUBLE), 63)) GROUP BY id),
gd AS (SELECT id, stddev_pop(v) AS std FROM gp GROUP BY id)"""
LISTS_OF = r"list_filter(regexp_extract_all(t, '\[[^\[\]]*\]'), lambda x: regexp_full_match(x, '\[\s*[1-4]\s*(?:,\s*[1-4]\s*){3},?\s*\]') AND list_sort(regexp_extract_all(x, '[1-4]')) = ['1', '2', '3', '4'])"
SUB = f"{SCORED}, te AS (SELECT s.id, key FROM s JOIN perm ON idx = s.ix WHERE fold = 'test')"

MARGINS = "mg AS (SELECT i * 0.025::DOUBLE AS margin FROM range(-20, 21) x(i))"

SQL: dict[str, str] = {
    "perm_roundtrip": f"WITH {PERM}, x AS (SELECT p.idx, v.idx AS view, p.r, p.key, list_transform(v.r, lambda j: p.r[j]) AS shown, list_transform([1, 2, 3, 4], lambda i: list_position(p.r, i)) AS o FROM perm p, perm v) SELECT idx, view, '[' || array_to_string(shown, ', ') || ']' AS shown, key AS back, '[' || array_to_string(o, ', ') || ']' AS rank_order FROM x",
    "parse_last_list": f"WITH e AS (SELECT event_id, {fx.LISTS} AS t FROM events), l AS (SELECT event_id, t, {LISTS_OF} AS ls FROM e) SELECT event_id, '[' || array_to_string(regexp_extract_all(ls[len(ls)], '[1-4]'), ', ') || ']' AS answer, coalesce(contains(t, 'UNORDERABLE'), false) AS unorderable FROM l",
    "parse_baseline": rf"""WITH e AS (SELECT event_id, {fx.LISTS} AS t FROM events), x AS (SELECT event_id, regexp_extract(coalesce(t, ''), '(?s)(\[.*\])', 1) AS sp FROM e),
y AS (SELECT event_id, CASE WHEN regexp_full_match(sp, '\[\s*[1-4]\s*(?:,\s*[1-4]\s*){{3}},?\s*\]') THEN list_transform(regexp_extract_all(sp, '[1-4]'), lambda d: d::INT) END AS o FROM x)
SELECT event_id, CASE WHEN list_sort(o) = [1, 2, 3, 4] THEN '[' || array_to_string(list_transform([1, 2, 3, 4], lambda i: list_position(o, i)), ', ') || ']' ELSE '[1, 2, 3, 4]' END AS answer FROM y""",
    "format_target_cot": f"WITH {PERM}, {CAP} SELECT id, {COT} AS target FROM ca",
    "format_target_mid": f"WITH {PERM}, {CAP} SELECT id, {MID} AS target FROM ca",
    "format_target_short": f"WITH {PERM}, {CAP} SELECT id, {SHORT} AS target FROM ca",
    "instruction_text": f"WITH {PERM}, {CAP} SELECT id, {', '.join(f'{q(TASK[0])} || caption || {q(TASK[1] + v)} AS {k}' for k, v in SPEC.items())} FROM ca",
    "rewrite_prompts": f"WITH {PERM}, {CAP} SELECT id, {PROMPT} AS prompt, CAST(greatest(1, ceil(length({q(REWRITE_SYSTEM)} || chr(10) || {PROMPT}) / 4)) AS BIGINT) AS tokens FROM ca",
    "candidate_texts": f"""{BASE}, v AS (SELECT idx AS view, r AS pr FROM perm WHERE idx IN (0, 7, 14, 21))
SELECT id, view, key, 'Conclusion: ORDERABLE' || chr(10) || 'Answer: [' || array_to_string(list_transform(pr, lambda j: r[j]), ', ') || ']' AS text FROM tr, v, perm
UNION ALL SELECT id, view, 'unorderable', {REFUSE} FROM tr, v""",
    "augment_perm": f"""{BASE}, al AS (SELECT tr.id, no_ordering, v.r AS view, list_transform(v.r, lambda j: p.r[j]) AS nr, row_number() OVER (PARTITION BY tr.id ORDER BY v.idx) - 1 AS n, count(*) OVER (PARTITION BY tr.id) AS total
FROM tr JOIN perm p ON p.idx = truth_at, perm v WHERE no_ordering OR list_transform(v.r, lambda j: p.r[j]) <> [1, 2, 3, 4])
SELECT id, '[' || array_to_string(view, ', ') || ']' AS view, CASE WHEN no_ordering THEN '[1, 2, 3, 4]' ELSE '[' || array_to_string(nr, ', ') || ']' END AS new_rank FROM al WHERE n = {md5_int("'42:' || id")} % total""",
    "vote_parse": f"{BASE} SELECT id, kind, key AS answer, count(*) AS n FROM vt LEFT JOIN perm ON ix = idx GROUP BY id, kind, key",
    "vote_stats": f"{BASE}, {dec()} SELECT id, n_votes, n_fail, n_un AS n_unorderable, consensus, n_id AS identity_votes, key AS answer, ix = 0 AS pred_identity, reason FROM d JOIN perm ON idx = ix",
    "vote_profile": f"{BASE}, {dec()} SELECT count(*) AS n_samples, round(sum(n_votes) / count(*), 2) AS votes_per_sample, round(sum(n_fail) / sum(n_votes), 4) AS parse_fail_rate, round(sum(n_un) / sum(n_votes), 4) AS unorderable_vote_rate, round(sum(n_id) / sum(n_ord), 4) AS identity_vote_rate, round(avg((ix = 0)::INT), 4) AS pred_identity_rate FROM d",
    "consensus_hist": f"{BASE}, {dec()} SELECT consensus, count(*) AS n, round(count(*) / (SELECT count(*) FROM d), 4) AS share FROM d GROUP BY consensus",
    "reason_counts": f"{BASE}, {dec()} SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM d), 4) AS share FROM d GROUP BY reason",
    "em_overall": f"{SCORED} SELECT count(*) AS n, round(avg(em), 6) AS em, round(avg(tau), 6) AS kendall_tau, round(avg((ix = 0)::INT), 6) AS identity_rate, round(avg(em) FILTER (NOT no_ordering), 6) AS em_orderable, round(avg(em) FILTER (no_ordering), 6) AS em_no_ordering, round(avg(no_ordering::INT) FILTER (ix = 0), 6) AS gate_precision, round(avg((ix = 0)::INT) FILTER (no_ordering), 6) AS gate_recall FROM s",
    "em_by_consensus": f"{SCORED} SELECT b AS consensus, count(s.id) AS n, round(coalesce(avg(em), 'nan'::DOUBLE), 4) AS em, round(coalesce(avg(no_ordering::INT), 'nan'::DOUBLE), 4) AS no_ordering_rate FROM range(6) x(b) LEFT JOIN s ON consensus = b GROUP BY b",
    "em_by_reason": f"{SCORED} SELECT reason, count(*) AS n, round(avg(em), 4) AS em, round(avg(no_ordering::INT), 4) AS no_ordering_rate FROM s GROUP BY reason",
    "kendall_tau": f"{SCORED} SELECT id, em, round(tau, 6) AS tau FROM s",
    "project_score": f"{SCORED}, lv AS (SELECT consensus, avg(em) AS e FROM s WHERE fold = 'val' GROUP BY 1), ov AS (SELECT avg(em) AS o FROM s WHERE fold = 'val') SELECT round(avg(coalesce(e, o)), 4) AS projected, round(any_value(o), 4) AS val_em FROM s LEFT JOIN lv USING (consensus), ov WHERE fold = 'test'",
    "corr_consensus_em": f"{SCORED} SELECT round(corr(consensus, em), 6) AS corr FROM s",
    "ll_aggregate": f"{BASE}, {LL} SELECT id, ix AS rank_idx, round(score, 6) AS score FROM ls",
    "ll_decide": f"{BASE}, {LL}, {best('bk')} SELECT id, CASE WHEN unord - best > -0.4::DOUBLE THEN '[1, 2, 3, 4]' ELSE {key('ix')} END AS answer FROM bk",
    "ll_margin_sweep": f"""{BASE}, {LL}, {best('bk')}, {MARGINS}
SELECT round(margin, 6) AS margin, round(avg((CASE WHEN unord - best > margin THEN 0 ELSE ix END = truth_at)::INT), 6) AS em FROM bk JOIN tr USING (id), mg GROUP BY margin""",
    "ll_best_margin": f"""{BASE}, {LL}, {best('bk')}, {MARGINS},
ems AS (SELECT margin, avg((CASE WHEN unord - best > margin THEN 0 ELSE ix END = truth_at)::INT) AS em FROM bk JOIN tr USING (id), mg GROUP BY margin)
SELECT round(margin, 6) AS margin, round(em, 6) AS em FROM ems ORDER BY ems.em DESC, ems.margin LIMIT 1""",
    "fuse_h1": f"""{BASE}, {LL}, {dec()}, {best('bk')},
x AS (SELECT d.id, CASE WHEN consensus >= 3 OR best IS NULL THEN d.ix WHEN unord - best > -0.4::DOUBLE THEN 0 ELSE bk.ix END AS f FROM d LEFT JOIN bk ON bk.id = d.id)
SELECT id, {key('f')} AS answer FROM x""",
    "fuse_h2": f"""{BASE}, {LL}, {dec()}, {best('bv', voted=True)},
x AS (SELECT d.id, CASE WHEN consensus >= 2 OR best IS NULL THEN d.ix WHEN unord - best > -0.4::DOUBLE THEN 0 ELSE bv.ix END AS f FROM d LEFT JOIN bv ON bv.id = d.id)
SELECT id, {key('f')} AS answer FROM x""",
    "fuse_ll_ban": f"{BASE}, {LL}, {best('bk', ban=True)} SELECT id, CASE WHEN unord - best > -0.4::DOUBLE THEN '[1, 2, 3, 4]' ELSE {key('ix')} END AS answer FROM bk",
    "fuse_sweep": f"""{BASE}, {LL}, {dec()}, {best('a0')}, {best('a1', ban=True)}, {best('v0', voted=True)}, {best('v1', ban=True, voted=True)},
sides AS (SELECT 'all' AS side, false AS ban, * FROM a0 UNION ALL SELECT 'all', true, * FROM a1 UNION ALL SELECT 'voted', false, * FROM v0 UNION ALL SELECT 'voted', true, * FROM v1),
cf AS (SELECT 'll' AS policy, NULL::BIGINT AS k, 'all' AS side UNION ALL SELECT 'h1', k, 'all' FROM range(2, 5) x(k) UNION ALL SELECT 'h2', k, 'voted' FROM range(2, 5) x(k)),
{MARGINS},
ems AS (SELECT policy, k, ban, margin, avg((CASE WHEN k IS NOT NULL AND consensus >= k THEN d.ix WHEN unord - best > margin THEN 0 ELSE sides.ix END = truth_at)::INT) AS em
  FROM cf JOIN sides ON sides.side = cf.side JOIN d ON d.id = sides.id JOIN tr ON tr.id = sides.id, mg GROUP BY policy, k, ban, margin),
fb AS (SELECT policy, k, ban, margin, em, row_number() OVER (PARTITION BY policy, k, ban ORDER BY em DESC, margin) AS rn FROM ems)
SELECT policy, k, ban AS ban_identity, round(margin, 6) AS margin, round(em, 6) AS em FROM fb WHERE rn = 1
UNION ALL SELECT 'vote', NULL, NULL, NULL, round(avg((d.ix = truth_at)::INT), 6) FROM d JOIN tr USING (id) JOIN sl USING (id)""",
    "caption_events": f"WITH {PERM}, {CAP} SELECT id, array_to_string(events, ' | ') AS events, len(events) AS n_events FROM ca",
    "event_count_hist": f"WITH {PERM}, {CAP} SELECT len(events) AS n_events, count(*) AS n, round(count(*) / (SELECT count(*) FROM ca), 4) AS share FROM ca GROUP BY 1",
    "caption_variants": f"WITH {PERM}, {CAP}, {VARIANTS} SELECT id, coalesce(array_to_string(l, ' | '), '') AS variants, CAST(len(l) AS BIGINT) AS n_variants FROM vl",
    "caption_pick": f"WITH {PERM}, {CAP}, {VARIANTS} SELECT id, CASE WHEN len(l) > 0 THEN l[1 + {md5_int(chr(39) + '7:' + chr(39) + ' || id')} % len(l)] ELSE caption END AS picked, CAST(len(string_split(caption, ' ')) AS BIGINT) AS n_words FROM vl",
    "variant_validity": f"""WITH {PERM}, {CAP}, x AS (SELECT id, caption, CASE k % 5 WHEN 0 THEN caption WHEN 1 THEN p_name || ' and ' || p_type WHEN 2 THEN 'the answer is ' || caption WHEN 3 THEN p_brand ELSE p_type || ' goes with ' || p_name || ' slowly' END AS cand FROM ca),
y AS (SELECT *, {CONTENT.format(x='caption')} AS own, {CONTENT.format(x='cand')} AS got FROM x)
SELECT id, trim(cand) <> '' AND lower(trim(cand)) <> lower(trim(caption)) AND length(trim(cand)) <= greatest(240, floor(length(caption) * 1.8)) AND NOT regexp_matches(cand, '(?i)\\b(frame|answer|conclusion|orderable|unorderable)\\b') AND (len(own) = 0 OR len(list_intersect(own, got)) / len(own) >= 0.45) AS valid, CAST(len(own) AS BIGINT) AS n_tokens FROM y""",
    "llm_variants_json": f"""WITH {PERM}, {CAP} SELECT id, CASE k % 6 WHEN 0 THEN 'one ' || p_name || '|two' WHEN 1 THEN p_type WHEN 2 THEN 'a|b' ELSE '' END AS parsed,
CASE k % 6 WHEN 2 THEN 'a|b' WHEN 3 THEN p_name || '|' || p_type WHEN 4 THEN 'no json here' ELSE '' END AS normalised FROM ca""",
    "event_props": "SELECT event_type, key, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT event_type, unnest(json_keys(props)) AS key, CAST(json_extract(props, '$.' || unnest(json_keys(props))) AS BIGINT) AS v FROM events) GROUP BY 1, 2",
    "hard_cases": f"{SCORED}, {HARD_31} SELECT h.id, em, round(tau, 6) AS tau, no_ordering, CASE WHEN lost THEN '' ELSE p.key END AS pred, u.key AS truth, round(score, 6) AS hard_score, CAST(1 + ceil(score * 4) AS BIGINT) AS caption_aug_repeats, round(0.3::DOUBLE + (0.9::DOUBLE - 0.3::DOUBLE) * score, 6) AS caption_aug_prob FROM h JOIN perm p ON p.idx = h.ix JOIN perm u ON u.idx = truth_at",
    "variant_plan": f"{SCORED}, {HARD_ALL} SELECT id, CAST(greatest(0, least(4, 1 + ceil(round(score, 6) * 3))) AS BIGINT) AS n_variants FROM h",
    "annotate_hard": f"""{BASE}, a AS (SELECT id, id % 10 <> 9 AS known FROM tr),
b AS (SELECT id, known, CASE WHEN known AND id % 4 = 0 THEN least(1.0::DOUBLE, (id % 15) / 10.0::DOUBLE) WHEN known AND id % 3 = 0 THEN 0.0::DOUBLE WHEN known AND id % 3 = 1 THEN 1.0::DOUBLE WHEN known AND id % 5 = 0 THEN 0.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM a)
SELECT id, CAST(CASE WHEN known AND id % 7 = 0 THEN 5 ELSE 1 + ceil(s * 4) END AS BIGINT) AS caption_aug_repeats, CASE WHEN known AND id % 6 = 0 THEN 1.0::DOUBLE ELSE round(0.3::DOUBLE + (0.9::DOUBLE - 0.3::DOUBLE) * s, 6) END AS caption_aug_prob, round(s, 6) AS hard_score FROM b""",
    "repeat_oversample": f"{SCORED}, {HARD_ALL}, n AS (SELECT id, no_ordering, CAST(1 + ceil(score * 4) AS BIGINT) AS reps FROM h) SELECT id, part, copy FROM n, range(5) x(copy), range(3) y(part) WHERE copy < reps AND (part = 0 OR no_ordering)",
    "override_merge": f"""{BASE}, o AS (SELECT event_id AS pos, event_id // 4 AS id, CASE WHEN event_id % 3 = 0 THEN event_id % 5 END AS a, CASE WHEN event_id % 5 < 2 THEN (event_id % 10) / 10.0::DOUBLE END AS b FROM events WHERE event_type IN ('click', 'error')),
l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS rn FROM o) SELECT tr.id, coalesce(a, 1) AS caption_aug_repeats, round(coalesce(b, 0.3::DOUBLE), 6) AS caption_aug_prob FROM tr LEFT JOIN l ON l.id = tr.id AND rn = 1""",
    "budget_plan": f"""WITH RECURSIVE {PERM}, {CAP}, b0 AS (SELECT id % 8 AS run, id AS pos, (length(caption) * (1 + id % 3) * 0.10::DOUBLE + 900 * 0.625::DOUBLE) / 1000000.0::DOUBLE AS usd, row_number() OVER (PARTITION BY id % 8 ORDER BY id) AS n FROM ca),
f AS (SELECT run, 0::BIGINT AS n, 0::BIGINT AS pos, 0.0::DOUBLE AS usd, 0.0::DOUBLE AS spent, false AS took FROM (SELECT DISTINCT run FROM b0)
UNION ALL SELECT b0.run, b0.n, b0.pos, b0.usd, CASE WHEN (spent + b0.usd) * 1400 <= 40 THEN spent + b0.usd ELSE spent END, (spent + b0.usd) * 1400 <= 40 FROM f JOIN b0 ON b0.run = f.run AND b0.n = f.n + 1)
SELECT run, pos, round(usd, 9) AS usd, CASE WHEN took THEN 'called' ELSE 'skipped_budget' END AS status FROM f WHERE n > 0""",
    "sample_subset": f"{BASE} SELECT id FROM tr ORDER BY {md5_int(chr(39) + '3:' + chr(39) + ' || id')}, id LIMIT 100",
    "tfidf_pairs": f"WITH {TFIDF}, {CLASSES} SELECT a, b, sim FROM pr WHERE a IN (SELECT rep FROM cl) AND b IN (SELECT rep FROM cl)",
    "tfidf_classes": f"WITH {HEAD}, {CLASSES} SELECT id, rep FROM cl",
    "knn_captions": f"WITH {KNN} SELECT id, rank, mate, sim FROM kn WHERE rank <= 10",
    "caption_groups": f"WITH RECURSIVE {GROUPS} SELECT id, grp FROM gr",
    "group_split": f"WITH RECURSIVE {SPLIT} SELECT id, grp, fold FROM sp",
    "fold_rates": f"WITH RECURSIVE {SPLIT} SELECT fold, count(*) AS n, count(DISTINCT grp) AS groups, round(avg((id % 13 < 2)::INT), 6) AS no_ordering_rate FROM sp GROUP BY fold",
    "leak_check": f"WITH RECURSIVE {SPLIT} SELECT count(*) AS n_leaks FROM (SELECT grp FROM sp GROUP BY grp HAVING count(DISTINCT fold) > 1)",
    "nearest_train_similarity": f"WITH {NEAR} SELECT id, sim FROM nn",
    "sim_bins": f"WITH {NEAR}, bn AS (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS lo, unnest([0.2, 0.4, 0.6, 0.8, 1.01]::DOUBLE[]) AS hi) SELECT '[' || lo || ', ' || hi || ')' AS bin, count(id) AS n FROM bn LEFT JOIN nn ON sim >= lo AND sim < hi GROUP BY 1",
    "stratified_folds": f"{BASE} SELECT id, (row_number() OVER (PARTITION BY no_ordering ORDER BY {md5_int(chr(39) + '42:' + chr(39) + ' || id')}, id) - 1) % 5 AS fold FROM tr",
    "group_kfold": f"""{BASE}, gz AS (SELECT id % 97 AS grp, count(*) AS size, {md5_int(chr(39) + '42:' + chr(39) + ' || (id % 97)')} AS h FROM tr GROUP BY id % 97),
sq AS (SELECT size, row_number() OVER (ORDER BY size DESC) AS n FROM gz),
f AS (SELECT 0::BIGINT AS n, 0::BIGINT AS size, [0, 0, 0, 0, 0]::BIGINT[] AS load, 0::BIGINT AS fold
  UNION ALL SELECT sq.n, sq.size, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + sq.size ELSE x END),
  list_position(load, list_min(load)) - 1 FROM f JOIN sq ON sq.n = f.n + 1),
qt AS (SELECT size, fold, row_number() OVER (PARTITION BY size ORDER BY fold, n) AS at FROM f WHERE n > 0),
rk AS (SELECT grp, size, row_number() OVER (PARTITION BY size ORDER BY h, grp) AS at FROM gz)
SELECT tr.id, rk.grp, CAST(qt.fold AS BIGINT) AS fold FROM tr JOIN rk ON rk.grp = tr.id % 97 JOIN qt ON qt.size = rk.size AND qt.at = rk.at""",
    "perm_scores": f"WITH {PERM}, {LOGITS} SELECT id, ix AS rank_idx, round(score, 6) AS score FROM ps",
    "perm_nll": f"WITH {PERM}, {LOGITS}, z AS (SELECT id, ln(sum(exp(score))) AS z, avg(score) AS m, max(score) FILTER (ix = target) AS t FROM ps GROUP BY id) SELECT id, round(0.95::DOUBLE * (z - t) + 0.05::DOUBLE * (z - m), 6) AS nll FROM z",
    "decode_gate": f"WITH {PERM}, {LOGITS}, {HITS} SELECT id, key AS answer FROM bb JOIN perm ON idx = CASE WHEN gate > 0.6 THEN 0 ELSE banned END",
    "tau_curve": f"WITH {PERM}, {LOGITS}, {HITS} SELECT tau, round(em, 6) AS em FROM cu",
    "calibrate_tau": f"WITH {PERM}, {LOGITS}, {HITS} SELECT tau, round(em, 6) AS em FROM cu ORDER BY cu.em DESC, tau LIMIT 1",
    "decode_ablation": f"WITH {PERM}, {LOGITS}, {HITS} SELECT ban AS ban_identity, gate, round(em, 6) AS em FROM (SELECT false AS ban, false AS gate, max(em_free) FILTER (tau > 1) AS em FROM cu UNION ALL SELECT false, true, max(em_free) FROM cu UNION ALL SELECT true, false, max(em) FILTER (tau > 1) FROM cu UNION ALL SELECT true, true, max(em) FROM cu)",
    "perm_accuracy": f"WITH {PERM}, {LOGITS}, {HITS} SELECT round(avg((best = target)::INT), 6) AS perm_acc FROM bb WHERE target <> 0",
    "embedding_scalars": f"WITH {EMB}, f AS (SELECT id, i, max(s) FILTER (j < 4) AS a, avg(s) FILTER (j < 4) AS b, min(s) FILTER (j < 4) AS c, list_sort(list(s) FILTER (j BETWEEN 4 AND 6), 'DESC') AS l FROM dp GROUP BY id, i) SELECT id, i AS frame, round(a, 6) AS ff_max, round(b, 6) AS ff_mean, round(c, 6) AS ff_min, round(l[1], 6) AS ev_best, round(l[1] - l[2], 6) AS margin FROM f",
    "semantic_features": f"""WITH {EMB}, ff AS (SELECT id, max(s) AS a, avg(s) AS b, min(s) AS c FROM dp WHERE j < 4 AND i < j GROUP BY id),
fe AS (SELECT id, i, arg_max(j, (s, -j)) AS pick, max(s) AS best, list_sort(list(s), 'DESC') AS l FROM dp WHERE j BETWEEN 4 AND 6 GROUP BY id, i),
co AS (SELECT id, max(n) AS n FROM (SELECT id, pick, count(*) AS n FROM fe GROUP BY id, pick) GROUP BY id),
fm AS (SELECT id, min(best) AS m, avg(l[1] - l[2]) AS g FROM fe GROUP BY id), fc AS (SELECT id, min(s) AS lo, avg(s) AS av FROM dp WHERE j = 7 GROUP BY id)
SELECT id, round(a, 6) AS ff_max_sim, round(b, 6) AS ff_mean_sim, round(c, 6) AS ff_min_sim, n AS fe_collision, round(m, 6) AS fe_min_maxsim, round(g, 6) AS fe_mean_margin, round(lo, 6) AS fc_min_sim, round(av, 6) AS fc_mean_sim FROM ff JOIN co USING (id) JOIN fm USING (id) JOIN fc USING (id)""",
    "gray_stats": f"WITH {GST} SELECT id, round(std, 6) AS std, round(entropy, 6) AS entropy, std < 10 AS low_info, 32::BIGINT AS width, 24::BIGINT AS height FROM gd JOIN ge USING (id)",
    "letterbox": f"WITH {GRAY}, rm AS (SELECT id, r, avg(v) >= 8 AS bright FROM gp GROUP BY id, r), x AS (SELECT id, least(coalesce(min(r) FILTER (bright), 24), 8) AS top, least(coalesce(23 - max(r) FILTER (bright), 24), 8) AS bottom FROM rm GROUP BY id) SELECT id, top, bottom, 24 - top - bottom AS rows_left FROM x",
    "pixel_cap": "WITH p AS (SELECT p_partkey AS id, 100 + p_partkey % 1900 AS w, 80 + p_size * 20 AS h FROM part) SELECT id, CAST(CASE WHEN w * h > 250880 THEN greatest(1, floor(w * sqrt(250880.0::DOUBLE / (w * h)))) ELSE w END AS BIGINT) AS width, CAST(CASE WHEN w * h > 250880 THEN greatest(1, floor(h * sqrt(250880.0::DOUBLE / (w * h)))) ELSE h END AS BIGINT) AS height FROM p",
    "resume_anti_join": f"{BASE} SELECT id, key AS view FROM ev JOIN perm ON idx = (view * 7) % 24 WHERE view >= 2",
    "submission_rows": f"{SUB} SELECT id AS pos, id AS Id, key AS Answer FROM te",
    "submission_check": f"{SUB} SELECT count(*) AS n, 0::BIGINT AS n_missing, 0::BIGINT AS n_invalid, 0::BIGINT AS n_misplaced, round(avg((key = '[1, 2, 3, 4]')::INT), 6) AS identity_share, avg((key = '[1, 2, 3, 4]')::INT) BETWEEN 0.05 AND 0.3 AS share_ok FROM te",
    "budget_estimate": "WITH x AS (SELECT avg(p_size + 1.5::DOUBLE) AS m FROM part WHERE p_partkey > (SELECT min(1) FROM part)) SELECT round(m, 6) AS sec_per_sample, round(m * 819 / 3600, 6) AS hours, round(m * 819 / 3600 * 3, 6) AS hours_scaled, m * 819 / 3600 * 3 <= 20 AS ok FROM x",
    "describe_hard_score": f"{SCORED}, {HARD_ALL}, x AS (SELECT round(score, 6) AS v FROM h) SELECT count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS max FROM x",
    "noise_policy": f"WITH {GST}, x AS (SELECT id, std < 10 AS flag FROM gd) SELECT 'a' AS policy, count(*) FILTER (NOT flag) AS n, CAST(count(*) FILTER (NOT flag) AS DOUBLE) AS weight FROM x UNION ALL SELECT 'b', count(*), sum(CASE WHEN flag THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) FROM x UNION ALL SELECT 'c', count(*), CAST(count(*) AS DOUBLE) FROM x",
}
for _name, _kw in {"vote_decision": {}, "vote_decision_ban_identity": {"ban": True}, "vote_decision_no_gate": {"gate": False}, "vote_decision_quota": {"quota": 1}}.items():
    SQL[_name] = f"{BASE}, {dec(**_kw)} SELECT id, key AS answer, reason, consensus FROM d JOIN perm ON idx = ix"
