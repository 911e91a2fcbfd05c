"""SQL for DuckDB of those queries that it can express on small tables."""

from __future__ import annotations

from panelloom.llm import line_rules as lr

_SPACE = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _fails(x: str) -> str:
    n = f"len(regexp_extract_all({x}, {_quoted(lr.WORD + '+')}))"
    bars = f"(length({x}) - length(replace({x}, '|', '')))"
    count = lambda p: f"len(regexp_extract_all({x}, {_quoted(p)}))"
    return (
        f"(NOT regexp_matches({x}, {_quoted(lr.SENTENCE_END)}) OR ({bars} >= 2 AND {bars} * 5 >= {n}) OR regexp_matches({x}, {_quoted(lr.NAVIGATION)})"
        f" OR regexp_matches({x}, {_quoted(lr.BOILERPLATE)}) OR {count(lr.SYMBOL_RUN)} * 10 > {n} * 3 OR {count('!!')} * 10 > {n} * 3"
        f" OR ({n} >= 3 AND {x} = upper({x}) AND {x} <> lower({x})))"
    )


LINES = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_SPACE}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_quoted(lr.WORD)})) AS ls FROM d),
i AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS p FROM w),
k AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, ws[p], ws[p + 1], ws[p + 2]) AS c FROM i),
r AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM k WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, unnest(ls) AS x FROM w), f AS (SELECT rid, x, {_fails("x")} AS bad FROM l),
s AS (SELECT rid, count(*) FILTER (WHERE bad) AS gone, coalesce(sum(length(x)) FILTER (WHERE bad), 0) AS lost, sum(length(x)) AS total FROM f GROUP BY rid),
b AS (SELECT w.*, len(ws) AS n, coalesce(r.n, 0) AS rep, coalesce(gone, 0) AS gone, coalesce(lost, 0) AS lost, coalesce(total, 0) AS total FROM w LEFT JOIN r USING (rid) LEFT JOIN s USING (rid))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, {_quoted(lr.SYMBOLS)})) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words, (n < 50 OR 100 * rep > 50 * n) AS base_failed,
 NOT (n < 50 OR 100 * rep > 50 * n) AND lost * 100 <= total * 50 AS kept, CAST(len(ls) AS BIGINT) AS n_lines, CAST(gone AS BIGINT) AS n_lines_removed, CAST(lost AS BIGINT) AS n_chars_lost FROM b"""

WORD_WINDOWS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w),
k AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h FROM i),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS least FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM m WHERE least < doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
s AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.p = c.p GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id) LEFT JOIN n USING (doc_id)"""

BYTE_WINDOWS = """WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
i AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM w),
k AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS key FROM i),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY key) AS least FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM m WHERE least < doc_id),
g AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM c),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE q IS NULL OR q <> p - 1) AS spans FROM g GROUP BY doc_id),
x AS (SELECT doc_id, substr(h, 2 * p + 1, 2) AS b, p FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM w WHERE doc_id IN (SELECT doc_id FROM n))),
s AS (SELECT x.doc_id, string_agg(b, '' ORDER BY x.p) AS kept FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.p = c.p GROUP BY x.doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN n IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""

COMPONENTS = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACE}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t(a, b) AS (SELECT a, b FROM u UNION SELECT t.a, u.b FROM t JOIN u ON t.b = u.a),
l AS (SELECT a AS doc_id, min(b) AS m FROM t GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(least(doc_id, coalesce(m, doc_id)) AS BIGINT) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)"""

SQL = {"op2_ngram_jaccard_join": COMPONENTS, "op4_substring_dedup": WORD_WINDOWS, "op9_line_rules": LINES, "op10_suffix_dedup": BYTE_WINDOWS}
