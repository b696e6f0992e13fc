"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tessera.llm import licenses, secrets

WORD = r"'[^\x20\x09-\x0D]+'"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    c = f"regexp_replace(coalesce({text}, ''), {_sql(licenses.LINE)}, chr(10), 'g')"
    c = f"trim(regexp_replace(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z]+', ' ', 'g'))"
    for spelling, to in licenses.SPELLINGS:
        c = f"replace({c}, {_sql(spelling)}, {_sql(to)})"
    return c


def op3() -> str:
    known = ", ".join(f"({_sql(k)}, {_sql(t)})" for k, t in licenses.KNOWN)
    digests = ", ".join(f"({_sql(k)}, {_sql(d)})" for k, d in licenses.DIGESTS)
    return f"""
WITH known AS (SELECT digest, min(k) AS license FROM (SELECT sha256({_canonical("t")}) AS digest, k FROM (VALUES {known}) v(k, t) UNION ALL SELECT d, k FROM (VALUES {digests}) w(k, d)) GROUP BY 1),
docs AS (SELECT doc_id, text, sha256({_canonical("text")}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
hits AS (SELECT l.doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices
  FROM (SELECT doc_id, sha256({_canonical("line")}) AS digest FROM lines) l JOIN known k USING (digest) GROUP BY 1)
SELECT d.doc_id, d.digest, k.license, coalesce(h.notices, '') AS notices
FROM docs d LEFT JOIN known k USING (digest) LEFT JOIN hits h ON h.doc_id = d.doc_id"""


OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, upper(sha1(body)) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(8), lambda i: (
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * i + 1, 5))::INTEGER >> 15) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * i + 1, 5))::INTEGER >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * i + 1, 5))::INTEGER >> 5) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, 5 * i + 1, 5))::INTEGER & 31) + 1, 1))), '') AS payload_digest,
  max(page_id) OVER (PARTITION BY hex) AS largest FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to FROM b"""

OP5 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w WHERE len(ws) >= 35),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS x FROM starts),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY x) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM rep, (SELECT unnest(range(35)) AS j)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""

OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS x
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id, w.doc_id = min(r.b) AS kept
FROM w LEFT JOIN size USING (doc_id) JOIN reach r ON r.a = w.doc_id GROUP BY 1, 2"""


def _hits(kind: str, pattern: str, rank: int, fails: str = "FALSE") -> str:
    rx = _sql(pattern)
    return f"""SELECT doc_id, start, {rank} AS rank, '{kind}' AS kind, start + length(hit) AS end_ FROM (
  SELECT doc_id, hits[i] AS hit, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0) AS start
  FROM (SELECT doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT doc_id, regexp_split_to_array(text, {rx}) AS gaps, regexp_extract_all(text, {rx}) AS hits FROM t WHERE regexp_matches(text, {rx})))) WHERE NOT ({fails})"""


def op10() -> str:
    rules = secrets.RULES
    fails = f"length(regexp_extract(hit, {_sql(rules[0][1])}, 2)) < 6"
    parts = " UNION ALL ".join(_hits(k, p, i, fails if k == "assign" else "FALSE") for i, (k, p) in enumerate(rules))
    joined = "coalesce(string_agg(kind || ':' || start || ':' || end_, ',' ORDER BY start, rank) {}, '')"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), h AS ({parts}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  {joined.format("FILTER (rank < 3)")} AS base, {joined.format("")} AS spans FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)"""
