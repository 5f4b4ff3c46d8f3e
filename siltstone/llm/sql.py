"""DuckDB SQL for those queries that SQL can express, over whole tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
n AS (SELECT doc_id, list_transform(range(1, len(ws) - 18), lambda i: md5_number(array_to_string(ws[i:i + 19], ' '))) AS names FROM d WHERE len(ws) >= 20),
s AS (SELECT doc_id, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM n),
later AS (SELECT doc_id, i, row_number() OVER (PARTITION BY name ORDER BY doc_id, i) > 1 AS hit FROM s),
m AS (SELECT w.doc_id, w.word, w.i, coalesce(bool_or(hit) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM w LEFT JOIN later USING (doc_id, i)),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS shingles FROM d),
c AS (SELECT shingles, min(doc_id) AS class, len(shingles) AS n FROM s WHERE len(shingles) > 0 GROUP BY shingles),
u AS (SELECT class, n, md5(unnest(shingles)) AS shingle FROM c),
p AS (SELECT a.class AS a, b.class AS b, a.n AS na, b.n AS nb, count(*) AS common FROM u a JOIN u b ON a.shingle = b.shingle AND a.class < b.class GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * common >= 85 * (na + nb - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reached) AS (SELECT class, class FROM c UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
k AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id FROM s LEFT JOIN c ON c.shingles = s.shingles LEFT JOIN k ON k.node = c.class
"""

SUFFIX_ARRAY = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
n AS (SELECT doc_id, list_transform(range(1, octet_length(t) + 1), lambda i: hex(t[i:i])) AS bytes, list_transform(range(1, octet_length(t) - 98), lambda i: md5_number(t[i:i + 99])) AS names FROM d),
b AS (SELECT doc_id, unnest(bytes) AS byte, generate_subscripts(bytes, 1) AS i FROM n),
s AS (SELECT doc_id, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM n),
later AS (SELECT doc_id, i, row_number() OVER (PARTITION BY name ORDER BY doc_id, i) > 1 AS hit FROM s),
m AS (SELECT b.doc_id, b.i, byte, coalesce(bool_or(hit) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), false) AS gone FROM b LEFT JOIN later USING (doc_id, i)),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM m),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

FILL_IN_MIDDLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, list_transform(range(4), lambda i: list_reduce(list_transform(string_split(substr(h, 8 * i + 1, 8), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT), lambda x, y: 16 * x + y)) AS d FROM t),
f AS (SELECT doc_id, text, u, len(u) AS n, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS a, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, length(array_to_string(list_filter(u, lambda x, i: i <= a), '')) AS p, length(array_to_string(list_filter(u, lambda x, i: i > a AND i <= b), '')) AS m FROM f),
o AS (SELECT *, substr(text, 1, p) AS prefix, substr(text, p + 1, m) AS middle, substr(text, p + m + 1) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN m::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""


def _best(*items: str) -> str:
    """The least of some structs by cost, then audit; nulls count for nothing."""
    return f"list_min(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL))"


def _edit(source: str, cost: str, letter: str, piece: str | None, when: str | None = None) -> str:
    text = f"{source}.text" if piece is None else piece if source.endswith(".e") else f"{source}.text || chr(10) || {piece}"
    made = f"{{'cost': {source}.cost + {cost}, 'audit': {source}.audit || '{letter}', 'text': {text}}}"
    return f"CASE WHEN {source} IS NOT NULL{f' AND {when}' if when else ''} THEN {made} END"


def _repair() -> str:
    insert = lambda s, role: _edit(s, "3", "I", f"'{role}:'")
    line, fits, more = "r.role || ':' || r.text", "NOT r.gone", "r.more"
    keep = lambda s, initial: _edit(s, more, "K", line, f"{fits} AND left(r.role, 1) = '{initial}'")
    rerole = lambda s, role: _edit(s, f"(3 + {more})", "R", f"'{role}:' || r.text", fits)
    delete = lambda s: _edit(s, "4", "D", None)
    scanned = {
        "e": delete("p.e"), "s": _best(delete("p.s"), keep("p.e", "s")),
        "u": _best(delete("p.u"), *(f(s, x) for s in ("p.e", "p.s", "p.a") for f, x in ((keep, "u"), (rerole, "user")))), "a": _best(delete("p.a"), keep("p.u", "a"), rerole("p.u", "assistant")),
    }
    step = lambda name: f"""{name}1 AS (SELECT key, n, i, e, s, a, {_best('x.u', insert('x.e', 'user'), insert('x.s', 'user'), insert('x.a', 'user'))} AS u FROM {name}0 x),
{name}2 AS (SELECT key, n, i, e, s, u, {_best('x.a', insert('x.u', 'assistant'))} AS a FROM {name}1 x)"""  # noqa: E731
    # an answer inserted after a question that was itself inserted: costs only rise, so two rounds of insertions reach everything
    return f"""
WITH RECURSIVE crc AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind FROM crc),
d AS (SELECT conv_id AS key, turn, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
  unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
d1 AS (SELECT *, row_number() OVER () AS row FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text, row) AS i, row_number() OVER (PARTITION BY key, role, text ORDER BY turn NULLS FIRST, row) AS seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d1),
t AS (SELECT *, bare = '' AS blank, bare <> '' AND seen > 1 AS dup, bare <> '' AND seen = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
  coalesce(lag(left(role, 1)) OVER (PARTITION BY key ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS odd FROM o),
r AS (SELECT key, i, role, text, blank OR dup AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS more FROM t),
c AS (SELECT key, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (odd) AS illegal FROM t GROUP BY key),
b0 AS (SELECT key, n, 0::BIGINT AS i, {{'cost': 0::BIGINT, 'audit': '', 'text': ''}} AS e, NULL::STRUCT(cost BIGINT, audit VARCHAR, text VARCHAR) AS s, NULL::STRUCT(cost BIGINT, audit VARCHAR, text VARCHAR) AS u, NULL::STRUCT(cost BIGINT, audit VARCHAR, text VARCHAR) AS a FROM c),
{step('b')},
chart AS (SELECT key, n, i, e, s, u, a FROM b2 UNION ALL
 (WITH n0 AS (SELECT p.key, p.n, p.i + 1 AS i, {', '.join(f'{v} AS {k}' for k, v in scanned.items())} FROM chart p JOIN r ON r.key IS NOT DISTINCT FROM p.key AND r.i = p.i + 1),
 {step('n')}, n3 AS (SELECT key, n, i, e, s, a, {_best('x.u', insert('x.e', 'user'), insert('x.s', 'user'), insert('x.a', 'user'))} AS u FROM n2 x) SELECT key, n, i, e, s, u, a FROM n3)),
g AS (SELECT key, {_best('e', 'a')} AS best FROM chart WHERE i = n)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN c ON c.key IS NOT DISTINCT FROM q.conv_id LEFT JOIN g ON g.key IS NOT DISTINCT FROM q.conv_id
"""


CONVERSATION_REPAIR = _repair()
