"""DuckDB SQL for the queries of this subpackage that SQL can express, written over whole tables and global windows."""

from __future__ import annotations

from .secrets import BASE_RULES, VENDOR_RULES

_CRC_TABLE = """SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))"""

OP6 = f"""
WITH crc AS ({_CRC_TABLE}),
h AS MATERIALIZED (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS hx FROM documents),
d AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS k, len(hx) // 2 + 1 AS size,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hx, '..'), lambda b: (16 * (instr('0123456789ABCDEF', b[1]) - 1) + instr('0123456789ABCDEF', b[2]) - 1)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32,
    md5(concat_ws(':', '17', coalesce(doc_id::VARCHAR, ''))) AS o FROM h, crc),
r AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY o, text_crc32::VARCHAR, size::VARCHAR) * 2 - 1)::DOUBLE / (count(*) OVER (PARTITION BY k) * 2) AS f FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY f, k, o, text_crc32::VARCHAR, size::VARCHAR) - 1 AS p, count(*) OVER () AS n FROM r),
s AS (SELECT *, (p * 16) // n AS sh FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, sh::INT AS shard, p - (sh * n + 15) // 16 AS slot, NULL::INT AS grown_shard FROM s
"""


def _budget(level: int, keys: list[str], parent: str) -> str:
    """Water levels by trial: the family's intake at each child's own full level tells which children are full."""
    path, up = ", ".join(keys), keys[:-1]
    same = " AND ".join(f"a.{k} = b.{k}" for k in up) or "true"
    using = f"JOIN b{level - 1} USING ({', '.join(up)})" if up else ""
    return f"""
f{level} AS (SELECT n{level}.*, {parent}::DOUBLE AS parent FROM n{level} {using}),
t{level} AS (SELECT {", ".join("a." + k for k in keys)}, any_value(a.c / a.w) AS mark, sum(least(b.c, b.w * (a.c / a.w))) AS intake, sum(CASE WHEN b.c / b.w <= a.c / a.w THEN b.c ELSE 0 END) AS full_c,
    sum(CASE WHEN b.c / b.w <= a.c / a.w THEN 0 ELSE b.w END) AS open_w, any_value(a.parent) AS parent FROM f{level} a JOIN f{level} b ON {same} AND a.w > 0 AND b.w > 0 GROUP BY ALL),
l{level} AS (SELECT {"".join(k + ", " for k in up)}max(CASE WHEN intake <= parent THEN CASE WHEN open_w > 0 THEN (parent - full_c) / open_w ELSE mark END END) AS water, max(CASE WHEN intake <= parent THEN 1 ELSE 0 END) AS any_full
    FROM t{level} {"GROUP BY ALL" if up else ""}),
b{level} AS (SELECT {path}, CASE WHEN w <= 0 THEN 0 WHEN any_full = 1 THEN least(c, w * water) ELSE least(c, parent * w / sum(w) OVER ({"PARTITION BY " + ", ".join(up) if up else ""})) END AS budget
    FROM f{level} LEFT JOIN l{level} {"USING (" + ", ".join(up) + ")" if up else "ON true"})"""


OP7 = f"""
WITH d AS (SELECT doc_id, lang, source,
    CASE WHEN try_cast(regexp_extract(coalesce(source, ''), '(\\d+)$', 1) AS INT) >= 10 THEN '1curated' ELSE '1web' END AS kd,
    CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS kl, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS ks,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS tokens,
    md5(concat_ws(':', 'row', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS o FROM documents),
leaves AS (SELECT kd, kl, ks, sum(tokens) AS held, 2 * sum(tokens) AS capacity FROM d GROUP BY ALL),
n2 AS (SELECT kd, kl, ks, capacity::DOUBLE AS c, 1.0::DOUBLE AS w FROM leaves),
n1 AS (SELECT kd, kl, sum(c) AS c, CASE kl WHEN '1en' THEN 0.55 WHEN '1de' THEN 0.15 WHEN '1fr' THEN 0.15 WHEN '1es' THEN 0.15 ELSE 0.05 END::DOUBLE AS w FROM n2 GROUP BY ALL),
n0 AS (SELECT kd, sum(c) AS c, CASE WHEN kd = '1web' THEN 0.6 ELSE 0.4 END::DOUBLE AS w FROM n1 GROUP BY ALL),
{_budget(0, ["kd"], "(SELECT sum(held) FROM leaves)")},
{_budget(1, ["kd", "kl"], "budget")},
{_budget(2, ["kd", "kl", "ks"], "budget")},
p AS (SELECT kd, kl, ks, e, budget - e * held AS part FROM (SELECT *, least(CASE WHEN held > 0 THEN floor(budget / held + 1e-9) ELSE 0 END, 2)::INT AS e FROM b2 JOIN leaves USING (kd, kl, ks))),
q AS (SELECT d.*, e, part, coalesce(sum(tokens) OVER (PARTITION BY kd, kl, ks ORDER BY md5(concat_ws(':', '29/' || e, o)), tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN p USING (kd, kl, ks)),
t AS (SELECT *, e + CASE WHEN part > 1e-6 AND before < part - 1e-6 THEN 1 ELSE 0 END AS times FROM q)
SELECT doc_id, lang, source, unnest(range(times))::INT AS epoch FROM t WHERE times > 0
"""

_LE = r"(?:[\x20\t\r\n]|\\[rn])*"
#: Rules in the syntax that DuckDB reads: neither flags inside groups, look-ahead nor possessive groups. Runs of up to four
#: dashes stand for what the look-ahead lets pass; nothing that follows a possessive group could start inside it.
_CASED = {"pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-{1,4}[^-])*-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_LE}(?:Proc-Type|DEK-Info):[^\r\n\\]*)*(?:{_LE}[A-Za-z0-9+/]{{16,}}={{0,2}})*"
    rf"(?:{_LE}[A-Za-z0-9+/]{{1,15}}={{1,2}}|\r?\n(?:[A-Za-z0-9+/]{{4}}){{1,3}}(?m:$))?)",
    "assign": r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""}


def _spans(rank: int, kind: str, regex: str, group: int, least: int) -> str:
    lit = _CASED.get(kind, regex).replace("'", "''")
    return f"""SELECT doc_id, rid, {rank} AS rank, '{kind}' AS kind, len(h) AS held,
    list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS l
    FROM (SELECT doc_id, rid, m, p, unnest(range(1, len(m) + 1)) AS i, unnest(g) AS h FROM (SELECT doc_id, rid, regexp_extract_all(t, '{lit}') AS m,
    regexp_extract_all(t, '{lit}', {group}) AS g, regexp_split_to_array(t, '{lit}') AS p FROM d)) WHERE length(h) >= {least}"""


_RULES = BASE_RULES + VENDOR_RULES
_BASE = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
OP10 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(_spans(i, r.kind, r.regex, r.group, r.least) for i, r in enumerate(_RULES))}),
j AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s::BIGINT || ':' || (s + l)::BIGINT, ',' ORDER BY s, rank) FILTER (kind IN ({_BASE})) AS base,
    string_agg(kind || ':' || s::BIGINT || ':' || (s + l)::BIGINT, ',' ORDER BY s, rank) AS spans FROM a GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (rid)
"""

_OK = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
OP5 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE {_OK}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

_NEXT = "CASE {} WHEN 2 THEN 3 ELSE 2 END"


def _crc(text: str) -> str:
    """CRC-32 of ASCII text, with the table ``crc`` at hand."""
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda b: ord(b)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


OP12 = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
k AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit FROM conversations, crc),
d AS (SELECT coalesce('1' || conv_id::VARCHAR, '0') AS key, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text, copy) AS pos, row_number() OVER (PARTITION BY key, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN last = '' THEN 1 WHEN seen > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, left(role, 1) AS i FROM o),
ins AS (SELECT * FROM (VALUES (0, 0, 0, ''), (0, 1, 2, 'u'), (0, 2, 3, 'ua'), (0, 3, 2, 'uau'), (1, 0, 1, ''), (1, 1, 2, 'u'), (1, 2, 3, 'ua'), (1, 3, 2, 'uau'),
    (2, 0, 2, ''), (2, 1, 3, 'a'), (2, 2, 2, 'au'), (2, 3, 3, 'aua'), (3, 0, 3, ''), (3, 1, 2, 'u'), (3, 2, 3, 'ua'), (3, 3, 2, 'uau')) x(s0, times, s1, made)),
ops AS (SELECT * FROM (VALUES ('K', 0), ('R', 3), ('D', 4)) x(op, price)),
w AS (SELECT DISTINCT key, 0::BIGINT AS pos, 0 AS s, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS way FROM f
    UNION ALL SELECT key, pos, s, min(way) AS way FROM (SELECT w.key, f.pos, CASE WHEN op = 'D' THEN s1 WHEN op = 'K' AND i = 's' THEN 1 ELSE {_NEXT.format("s1")} END AS s,
        {{'c': way.c + 3 * times + price + CASE WHEN op <> 'D' AND fault = 3 THEN 3 ELSE 0 END, 'a': way.a || repeat('I', times) || op,
        'o': way.o || replace(replace(made, 'a', 'assistan:' || chr(1)), 'u', 'user:' || chr(1)) || CASE op WHEN 'D' THEN '' ELSE CASE WHEN op = 'K' THEN role WHEN s1 = 2 THEN 'assistant' ELSE 'user' END || ':' || text || chr(1) END}} AS way
        FROM w JOIN f ON w.key = f.key AND f.pos = w.pos + 1 JOIN ins ON s0 = s JOIN ops ON op = 'D' OR (fault IN (0, 3) AND (op = 'R' OR (i = 's' AND s1 = 0) OR i = CASE WHEN s1 = 2 THEN 'a' ELSE 'u' END))) GROUP BY key, pos, s),
e AS (SELECT key, min({{'c': way.c + CASE s WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'a': way.a || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'o': way.o || CASE s WHEN 1 THEN 'user:' || chr(1) || 'assistant:' || chr(1) WHEN 2 THEN 'assistant:' || chr(1) ELSE '' END}}) AS way FROM w JOIN (SELECT key, max(pos) AS pos FROM f GROUP BY ALL) USING (key, pos) GROUP BY key),
p AS (SELECT key, turn, fault, pos > 1 AND lag(i) OVER (PARTITION BY key ORDER BY pos) || i NOT IN ('su', 'ua', 'au') AS bad FROM f),
g AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (bad) AS illegal FROM p GROUP BY key)
SELECT conv_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, coalesce(way.c, 0)::BIGINT AS cost, coalesce(way.a, '') AS audit,
    sha256(coalesce(replace(replace(left(way.o, length(way.o) - 1), chr(1), chr(10)), 'assistan:', 'assistant:'), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('1' || conv_id::VARCHAR, '0') AS key FROM conversations) LEFT JOIN g USING (key) LEFT JOIN e USING (key)
"""

OP13 = f"""
WITH crc AS ({_CRC_TABLE}),
t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY ALL),
c AS MATERIALIZED (SELECT n.conv_id, n.conv_id - n.conv_id % 5 AS family, {_crc("n.conv_id::VARCHAR")} % 9 AS h FROM n, crc),
r AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = family AND pos < h
    UNION ALL SELECT c.conv_id, pos - h + least(coalesce(n, 0), h), role, text FROM c JOIN t USING (conv_id) LEFT JOIN n ON n.conv_id = family WHERE pos >= h),
p AS MATERIALIZED (SELECT conv_id, pos + 1 AS depth, strlen(text) AS size, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS node FROM r),
q AS MATERIALIZED (SELECT conv_id, depth, size, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p
    UNION ALL SELECT conv_id, 0, 0, 'root', NULL, NOT EXISTS (FROM p WHERE p.conv_id = c.conv_id) FROM c),
g AS MATERIALIZED (SELECT node, depth, any_value(parent) AS parent, any_value(size) AS size, count(*) AS n_convs, min(conv_id) AS conv_id, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY node, depth),
k AS (SELECT parent AS node, count(*) AS n_children FROM g WHERE parent IS NOT NULL GROUP BY ALL),
s AS (SELECT q.node, sum((k.node IS NULL)::INT) AS n_leaves, sum((g.n_convs - 1) * g.size) AS saved_tokens FROM g LEFT JOIN k USING (node) JOIN q ON q.conv_id = g.conv_id AND q.depth <= g.depth GROUP BY q.node)
SELECT g.conv_id, g.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, g.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, g.ends_sha256
FROM g LEFT JOIN k USING (node) JOIN s USING (node) LEFT JOIN g u ON u.node = g.parent
"""

ORACLE_SQL = {"op12_conversation_repair": OP12, "op13_prefix_trie": OP13, "op5_pivot_topk": OP5, "op6_interleave_shards": OP6, "op7_mixture": OP7, "op10_secrets": OP10}
