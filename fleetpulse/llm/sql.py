"""SQL with the rows of the operators that need long statements."""

from __future__ import annotations

# Bytes are pairs of hexadecimal digits, so that substrings count bytes.
SUFFIX = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), n AS (SELECT *, length(h) // 2 AS n FROM d),
cut AS (  -- a substring is found by counting from the start, so long texts are cut first
  SELECT r, doc_id, base, least(n - 49 - base, 500) AS m, substring(h, 2 * base + 1, 1098) AS h FROM (
    SELECT r, doc_id, h, n, unnest(range(0, n - 49, 500)) AS base FROM n WHERE n >= 50 AND doc_id IS NOT NULL)
),
g AS (SELECT r, doc_id, base + i AS p, substring(h, 2 * i + 1, 100) AS s FROM (SELECT r, doc_id, base, h, unnest(range(m)) AS i FROM cut)),
least_of AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS b FROM g JOIN least_of USING (s) WHERE m < doc_id),
runs AS (SELECT r, p, sum(CASE WHEN b IS NULL OR p > b + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM hit),
spans AS (SELECT r, k, min(p) AS a, max(p) + 50 AS z FROM runs GROUP BY r, k),
gaps AS (
  SELECT r, a, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS begin, a AS stop FROM spans
  UNION ALL SELECT n.r, n.n + 1, coalesce(max(z), 0), n.n FROM n LEFT JOIN spans ON spans.r = n.r GROUP BY n.r, n.n
), kept AS (SELECT n.r, string_agg(substring(h, 2 * begin + 1, 2 * (stop - begin)), '' ORDER BY a) AS k FROM gaps JOIN n ON n.r = gaps.r GROUP BY n.r)
SELECT doc_id, n AS n_bytes, (n - length(kept.k) // 2)::BIGINT AS n_removed,
  (SELECT count(*) FROM spans WHERE spans.r = n.r) AS n_spans, sha256(unhex(kept.k)) AS kept_sha256
FROM n JOIN kept ON kept.r = n.r
"""


def conversations() -> str:
    """The costs from the last row to the first one; a state's value is its cost, edits and repaired rows, compared in this order."""
    crc = (
        "xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, length(key) + 1), lambda i: "
        "[ord(key[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) "
        "ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END) END), 4294967295)"
    )
    far = 1 << 40

    def state(cost: str, letter: str, line: str, after: str) -> str:
        return f"{{'c': {after}.c + {cost}, 'a': '{letter}' || {after}.a, 't': {line} {after}.t}}"

    def line(who: str, text: str = "''") -> str:
        return f"[{who} || ':' || {text}] ||"

    due = {0: "s2", 1: "s2", 2: "s3", 3: "s2"}
    name = {0: "'user'", 1: "'user'", 2: "'assistant'", 3: "'user'"}
    keeps = {0: "CASE initial WHEN 's' THEN s1 WHEN 'u' THEN s2 END", 1: "CASE initial WHEN 'u' THEN s2 END", 2: "CASE initial WHEN 'a' THEN s3 END", 3: "CASE initial WHEN 'u' THEN s2 END"}
    rows = []
    for q in range(4):
        drop = state("4", "D", "", f"s{q}")
        change = state("3 + late", "R", line(name[q], "text"), due[q])
        keep = state("late", "K", line("role", "text"), f"({keeps[q]})")
        rows.append(
            f"CASE WHEN fault IN (1, 2) THEN {drop} WHEN ({keeps[q]}) IS NULL THEN least({drop}, {change}) "
            f"ELSE least({drop}, {change}, {keep}) END AS s{q}"
        )
    closed = [
        "least(s0, {u}, {ua}) AS s0", "least(s1, {u}, {ua}) AS s1", "least(s2, {a}) AS s2", "least(s3, {u}) AS s3",
    ]
    u, a = state("3", "I", line("'user'"), "s2"), state("3", "I", line("'assistant'"), "s3")
    ua = f"{{'c': s3.c + 6, 'a': 'II' || s3.a, 't': ['user:', 'assistant:'] || s3.t}}"
    close = ", ".join(c.format(u=u, a=a, ua=ua) for c in closed)
    end = ", ".join(f"{{'c': {0 if q in (0, 3) else far}::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s{q}" for q in range(4))
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), f AS (SELECT *, {crc} % 20 AS fate FROM k),
dealt AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM f WHERE fate <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, role[1] AS initial FROM dealt
), seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o),
ill AS (
  SELECT *, CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2 WHEN bare[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM seen
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM ill GROUP BY conv_id
), back AS (
  SELECT conv_id, n AS i, {close} FROM (SELECT conv_id, n, {end} FROM counts)
  UNION ALL
  SELECT conv_id, i - 1 AS i, {close} FROM (
    SELECT x.conv_id, x.i, {", ".join(rows)} FROM (
      SELECT back.*, ill.role, ill.text, ill.initial, ill.fault, CASE WHEN ill.fault = 3 THEN 3 ELSE 0 END AS late
      FROM back JOIN ill ON ill.conv_id IS NOT DISTINCT FROM back.conv_id AND ill.i = back.i
    ) x
  )
), best AS (SELECT conv_id, s0.c AS cost, s0.a AS audit, sha256(array_to_string(s0.t, chr(10))) AS h FROM back WHERE i = 0)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def clustering(width: int, clusters: int, rounds: int, scale: int) -> str:
    """Every round as a pair of steps: assign, then move."""
    near = (
        "SELECT vec_id, r, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM ("
        "SELECT x.vec_id, x.r, x.v, y.c, list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d "
        "FROM ints x, m{k} y) GROUP BY vec_id, r, v"
    )
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(k=k)})")
        steps.append(
            f"t{k} AS (SELECT c, list(q ORDER BY j) AS v FROM (SELECT c, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS q "
            f"FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{k}) GROUP BY c, j) GROUP BY c)"
        )
        steps.append(f"m{k + 1} AS MATERIALIZED (SELECT m{k}.c, coalesce(t{k}.v, m{k}.v) AS v FROM m{k} LEFT JOIN t{k} USING (c))")
    return f"""
WITH ints AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), v) - 1 AS c, v FROM ints QUALIFY c < {clusters}
), {", ".join(steps)}, last AS ({near.format(k=rounds)})
SELECT vec_id, last.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY last.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m{rounds}.v::BIGINT[], ',')) AS centroid_sha256
FROM last JOIN m{rounds} ON m{rounds}.c = last.c
"""
