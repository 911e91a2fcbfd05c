"""The queries' questions in DuckDB's SQL."""

from __future__ import annotations

_EVENTS = """e0 AS (SELECT user_id, ts, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
e1 AS (SELECT *, lead(value, 1) OVER w AS next_value, lead(ts, 1) OVER w AS lead_time FROM e0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ev AS (SELECT * FROM e1 WHERE lead_time IS NOT NULL)"""
_MONTHS = """m0 AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_extendedprice) AS y, sum(l_quantity) AS quantity,
 avg(l_discount) AS discount, avg(l_tax) AS tax, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
m1 AS (SELECT *, lead(y, 1) OVER w AS next_y, lead(month, 1) OVER w AS lead_time FROM m0 WINDOW w AS (PARTITION BY l_suppkey ORDER BY month)),
mo AS (SELECT * FROM m1 WHERE lead_time IS NOT NULL)"""
_DAYS = """d0 AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS y FROM events GROUP BY 1, 2),
d1 AS (SELECT *, lead(day, 1) OVER (PARTITION BY user_id ORDER BY day) AS lead_time FROM d0),
dy AS (SELECT * FROM d1 WHERE lead_time IS NOT NULL)"""
_ENTITY = """ids AS (SELECT DISTINCT user_id FROM ev),
r0 AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id::VARCHAR || '|17'), user_id::VARCHAR) AS r, count(*) OVER () AS c FROM ids),
outer_ AS (SELECT user_id, CASE WHEN r <= greatest(1, ceil(c * 0.2)) THEN 'test' ELSE 'train' END AS outer_role FROM r0),
inner_ AS (SELECT user_id, ntile(3) OVER (ORDER BY md5(user_id::VARCHAR || '|18'), user_id::VARCHAR) AS fold FROM outer_ WHERE outer_role = 'train')"""
_FORWARD = """t0 AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS r, count(*) OVER () AS c FROM (SELECT DISTINCT day FROM dy)),
b AS (SELECT day AS b FROM t0 WHERE r = c - greatest(1, ceil(c * 0.25))),
o AS (SELECT dy.*, CASE WHEN day >= b THEN 'test' WHEN lead_time < b THEN 'train' ELSE 'purged' END AS outer_role FROM dy, b)"""
_INNER = """tr AS (SELECT * FROM o WHERE outer_role = 'train'),
it AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS r, count(*) OVER () AS c FROM (SELECT DISTINCT day FROM tr)),
second AS (SELECT lead_time AS t2 FROM tr ORDER BY lead_time LIMIT 1 OFFSET 1),
f AS (SELECT greatest(1, (SELECT count(*) FROM it, second WHERE day <= t2)) AS first_),
bl AS (SELECT day, ntile(3) OVER (ORDER BY day) AS blk FROM it, f WHERE r >= first_),
st AS (SELECT blk, min(day) AS s, lead(min(day)) OVER (ORDER BY blk) AS e FROM bl GROUP BY blk),
fr AS (SELECT tr.user_id, tr.day, tr.lead_time, st.blk, CASE WHEN tr.day >= s AND (e IS NULL OR tr.day < e) THEN 'test' WHEN lead_time < s THEN 'train'
 WHEN tr.day < s THEN 'purged' ELSE 'dropped' END AS role FROM tr, st)"""
_TERCILES = "q AS (SELECT quantile_cont(k, 1/3.0) AS c1, quantile_cont(k, 2/3.0) AS c2 FROM ev)"
_MEDIAN = "q AS (SELECT quantile_cont(k, 0.5) AS c FROM ev), sf AS (SELECT ev.*, CASE WHEN k > c THEN 1 ELSE 0 END AS state FROM ev, q)"
_FOLDS = """fx AS (SELECT ev.next_value AS y, CASE WHEN k > 49.5 THEN 1.0 ELSE 0.0 END AS x, i.fold AS own, g.fold AS fold
 FROM ev JOIN inner_ i USING (user_id), (SELECT unnest([1, 2, 3]) AS fold) g),
fm AS (SELECT fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM fx WHERE own <> fold GROUP BY fold),
tm AS (SELECT fold, avg(y) AS m FROM fx WHERE own = fold GROUP BY fold),
r2 AS (SELECT fold, round(1 - sum((y - a - b * x) * (y - a - b * x)) / sum((y - m) * (y - m)), 8) AS r2 FROM fx JOIN fm USING (fold) JOIN tm USING (fold) WHERE own = fold GROUP BY fold)"""


def _composite() -> str:
    z = " + ".join(f"(m.{c} - s.a_{c}) / s.d_{c}" for c in ("quantity", "discount", "tax"))
    stats = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS d_{c}" for c in ("quantity", "discount", "tax"))
    return f"""WITH {_MONTHS}, s AS (SELECT {stats} FROM mo), z AS (SELECT ({z}) / 3.0 AS v FROM mo m, s),
q AS (SELECT quantile_cont(v, 1/3.0) AS c1, quantile_cont(v, 2/3.0) AS c2 FROM z)
SELECT CAST((v > c1)::INT + (v > c2)::INT AS BIGINT) AS state, count(*) AS n FROM z, q GROUP BY 1"""


def _top_k() -> str:
    parts = []
    for c in ("quantity", "discount", "tax"):
        cuts = f"(SELECT quantile_cont({c}, 0.5) AS h, quantile_cont({c}, 1/3.0) AS c1, quantile_cont({c}, 2/3.0) AS c2 FROM mo)"
        parts.append(f"SELECT 'q2:{c}' AS name, ({c} > h)::INT AS state, next_y FROM mo, {cuts}")
        parts.append(f"SELECT 'q3:{c}' AS name, ({c} > c1)::INT + ({c} > c2)::INT AS state, next_y FROM mo, {cuts}")
    union = " UNION ALL ".join(parts)
    return f"""WITH {_MONTHS}, l AS ({union}), g AS (SELECT avg(next_y) AS g, var_pop(next_y) AS v FROM mo),
s AS (SELECT name, state, count(*) AS n, avg(next_y) AS m FROM l GROUP BY 1, 2)
SELECT name, count(*) AS states, round(sum(n * (m - g) * (m - g)) / sum(n) / first(v), 8) AS eta2 FROM s, g GROUP BY name
ORDER BY 0.25 * sum(n * (m - g) * (m - g)) / sum(n) / first(v) + 0.1 * (1 - ln(count(*)) / ln(sum(n))) DESC, sum(n * (m - g) * (m - g)) / sum(n) / first(v) DESC, states DESC, name DESC LIMIT 4"""


def _kmeans() -> str:
    d = ", ".join(f"((quantity - 600.0) / 200.0 - ({a})) * ((quantity - 600.0) / 200.0 - ({a})) + ((tax - 0.04) / 0.01 - ({b})) * ((tax - 0.04) / 0.01 - ({b})) AS d{k}" for k, (a, b) in enumerate(((-1.0, 0.5), (0.0, -0.75), (1.25, 0.25))))
    return f"""WITH {_MONTHS}, d AS (SELECT {d} FROM mo)
SELECT CAST(CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS BIGINT) AS state, count(*) AS n FROM d GROUP BY 1"""


SQL: dict[str, str] = {
    "next_value_by_state": f"WITH {_EVENTS}, {_MEDIAN} SELECT CAST(state AS BIGINT) AS state, count(*) AS n, round(avg(next_value), 6) AS mean_next, round(stddev_pop(next_value), 6) AS sd_next FROM sf GROUP BY state",
    "panel_summary": "SELECT count(*) AS row_count, count(DISTINCT o_custkey) AS entity_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)) AS duplicate_entity_times FROM orders",
    "lagged_table": f"WITH {_EVENTS} SELECT user_id, event_id, value, k, next_value AS value__lead1, lead_time FROM ev",
    "lagged_lag2_multi": f"""WITH {_MONTHS}, l AS (SELECT l_suppkey, month, lead(y, 2) OVER w AS a, lead(quantity, 2) OVER w AS b, lead(month, 2) OVER w AS lead_time FROM m0 WINDOW w AS (PARTITION BY l_suppkey ORDER BY month))
SELECT l_suppkey, month, round(a, 2) AS y__lead2, round(b, 2) AS quantity__lead2, lead_time FROM l WHERE lead_time IS NOT NULL""",
    "eligibility_counts": f"WITH {_MONTHS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE month(lead_time) % 5 <> 0) AS usable, count(*) FILTER (WHERE month(lead_time) % 5 = 0) AS ineligible FROM mo",
    "turn_leads": "WITH l AS (SELECT role, lead(CAST(length(text) AS DOUBLE)) OVER w AS y, lead(turn) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT role, count(*) AS n, round(avg(y), 6) AS mean_next FROM l WHERE t IS NOT NULL GROUP BY role",
    "entity_outer_split": f"WITH {_EVENTS}, {_ENTITY} SELECT user_id, outer_role, count(*) AS n FROM ev JOIN outer_ USING (user_id) GROUP BY 1, 2",
    "entity_inner_folds": f"WITH {_EVENTS}, {_ENTITY} SELECT user_id, CAST(fold AS BIGINT) AS fold, count(*) AS n FROM ev JOIN inner_ USING (user_id) GROUP BY 1, 2",
    "forward_outer_split": f"WITH {_DAYS}, {_FORWARD} SELECT day, outer_role, count(*) AS n FROM o GROUP BY 1, 2",
    "forward_inner_folds": f"""WITH {_DAYS}, {_FORWARD}, {_INNER}
SELECT day, fold_1, fold_2, fold_3, count(*) AS n FROM (SELECT user_id, day, max(CASE WHEN blk = 1 THEN role END) AS fold_1, max(CASE WHEN blk = 2 THEN role END) AS fold_2, max(CASE WHEN blk = 3 THEN role END) AS fold_3 FROM fr GROUP BY 1, 2) GROUP BY 1, 2, 3, 4""",
    "interpolation_split": f"""WITH {_MONTHS}, p AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY month) - 1 AS pos, count(*) OVER (PARTITION BY l_suppkey) AS len FROM mo),
c AS (SELECT *, greatest(1, ceil(len * 0.25)) AS held FROM p), s AS (SELECT *, greatest(1, floor((len - held) / 2)) AS start_ FROM c),
t AS (SELECT *, pos >= start_ AND pos < start_ + held AS test FROM s),
h AS (SELECT *, min(CASE WHEN test THEN month END) OVER (PARTITION BY l_suppkey) AS a, max(CASE WHEN test THEN lead_time END) OVER (PARTITION BY l_suppkey) AS z FROM t)
SELECT l_suppkey, month, CASE WHEN test THEN 'test' WHEN month <= z AND lead_time >= a THEN 'purged' ELSE 'train' END AS outer_role FROM h""",
    "split_coverage": f"""WITH {_DAYS}, {_FORWARD}, {_INNER}, al AS (SELECT 'outer_role' AS split, outer_role AS role, user_id, day, lead_time FROM o
 UNION ALL SELECT 'fold_' || blk, role, user_id, day, lead_time FROM fr)
SELECT split, role, count(*) AS rows, count(DISTINCT user_id) AS entities, min(day) AS first_time, max(day) AS last_time, max(lead_time) AS last_target_time FROM al GROUP BY 1, 2""",
    "quantile_q2": f"WITH {_EVENTS}, {_MEDIAN} SELECT user_id, event_id, CAST(state AS BIGINT) AS state FROM sf",
    "quantile_q3": f"WITH {_EVENTS}, {_TERCILES} SELECT user_id, event_id, CAST((k > c1)::INT + (k > c2)::INT AS BIGINT) AS state FROM ev, q",
    "composite_q3": _composite(),
    "merged_states": f"WITH {_EVENTS}, {_TERCILES} SELECT user_id, event_id, CAST(CASE WHEN k > c2 THEN 2 ELSE 0 END AS BIGINT) AS state FROM ev, q",
    "state_sizes": f"WITH {_EVENTS}, {_TERCILES} SELECT CAST((k > c1)::INT + (k > c2)::INT AS BIGINT) AS state, count(*) AS n FROM ev, q GROUP BY 1",
    "kmeans_assign": _kmeans(),
    "canonical_labels": "SELECT event_type, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS BIGINT) AS canonical FROM events GROUP BY event_type",
    "simple_ols": f"WITH {_MONTHS} SELECT round(regr_slope(next_y, quantity), 4) AS slope, round(regr_intercept(next_y, quantity), 2) AS intercept, round(regr_r2(next_y, quantity), 6) AS r2, count(*) AS n FROM mo",
    "joint_two_treatment_ols": f"""WITH {_MONTHS}, c AS (SELECT covar_pop(quantity, quantity) AS aa, covar_pop(quantity, n) AS ab, covar_pop(n, n) AS bb, covar_pop(quantity, next_y) AS ay, covar_pop(n, next_y) AS by_ FROM mo)
SELECT round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 3) AS b_quantity, round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 1) AS b_n, CAST(3 AS BIGINT) AS design_rank FROM c""",
    "heldout_r2": f"""WITH {_EVENTS}, {_ENTITY}, p AS (SELECT ev.next_value AS y, k, outer_role FROM ev JOIN outer_ USING (user_id)),
f AS (SELECT regr_slope(y, k) AS b, regr_intercept(y, k) AS a FROM p WHERE outer_role = 'train'), m AS (SELECT avg(y) AS m FROM p WHERE outer_role = 'test')
SELECT round(1 - sum((y - a - b * k) * (y - a - b * k)) / sum((y - m) * (y - m)), 8) AS r2 FROM p, f, m WHERE outer_role = 'test'""",
    "design_transform_report": f"""WITH {_EVENTS}, {_ENTITY}, p AS (SELECT ev.*, outer_role FROM ev JOIN outer_ USING (user_id)), t AS (SELECT * FROM p WHERE outer_role = 'test'),
known AS (SELECT DISTINCT event_type FROM p WHERE outer_role = 'train' AND event_type <> 'click')
SELECT 'k_text' AS column_name, count(*) FILTER (WHERE event_id % 7 = 0) AS missing, count(*) FILTER (WHERE event_id % 7 <> 0 AND event_id % 11 = 0) AS invalid_numeric, CAST(0 AS BIGINT) AS unknown_category FROM t
UNION ALL SELECT 'event_type', count(*) FILTER (WHERE event_type IS NULL), CAST(0 AS BIGINT), count(*) FILTER (WHERE event_type NOT IN (SELECT event_type FROM known)) FROM t""",
    "outcome_specificity": f"WITH {_EVENTS}, {_MEDIAN}, g AS (SELECT avg(next_value) AS g, var_pop(next_value) AS v FROM sf), s AS (SELECT state, count(*) AS n, avg(next_value) AS m FROM sf GROUP BY state) SELECT round(sum(n * (m - g) * (m - g)) / sum(n) / first(v), 9) AS eta2 FROM s, g",
    "validation_specificity": f"WITH {_EVENTS}, {_ENTITY}, {_FOLDS} SELECT CAST(fold AS BIGINT) AS fold, r2 FROM r2",
    "stability": f"WITH {_EVENTS}, {_ENTITY}, {_FOLDS} SELECT round(1 / (1 + stddev_pop(r2)), 6) AS stability FROM r2",
    "compression": f"WITH {_EVENTS}, {_MEDIAN} SELECT round(1 - log2(count(DISTINCT state)) / log2(count(*)), 9) AS compression FROM sf",
    "ranking_score": f"""WITH {_EVENTS}, {_ENTITY}, {_FOLDS}, c AS (SELECT round(1 - log2(2) / log2(count(*)), 9) AS c FROM ev)
SELECT round(0.45 * greatest(avg(r2), 0) + 0.25 * avg(greatest(r2, 0)) + 0.2 / (1 + stddev_pop(r2)) + 0.1 * first(c), 6) AS ranking_score FROM r2, c""",
    "residual_correlation": f"""WITH {_MONTHS}, s AS (SELECT tax, discount, quantity > 600 AS g FROM mo), d AS (SELECT tax - avg(tax) OVER (PARTITION BY g) AS x, discount - avg(discount) OVER (PARTITION BY g) AS z FROM s)
SELECT round((SELECT avg(x * x) FROM d) / (SELECT var_pop(tax) FROM s), 8) AS fraction_remaining, round(corr(x, z), 8) AS residual_correlation FROM d""",
    "coarsening": f"WITH {_EVENTS}, {_MEDIAN} SELECT count(DISTINCT k) AS observed_values, count(DISTINCT state) AS macro_states FROM sf",
    "top_k": _top_k(),
}
