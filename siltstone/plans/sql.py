"""The queries of plans.queries written a second time, as SQL.

The SQL is relational where the operators work within a row: registry tables
are joined, windows pick firsts and bests. Fixed values come from the same rule
tables; everything else is independent of the operators.
"""

from __future__ import annotations

from siltstone.functions.regex import SPACE, Pattern
from siltstone.functions.text import parts_of
from siltstone.operators.grounding import api_pattern
from siltstone.plans.corpus import SNIPPETS
from siltstone.rules import artifact as A
from siltstone.rules import framework as W
from siltstone.rules import language as L
from siltstone.rules import limits as R
from siltstone.rules import questions as Q
from siltstone.rules import registry as G
from siltstone.rules import runtime as T
from siltstone.rules import signals as S
from siltstone.rules import texts as X


def q(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def filled(template: str, **sql: str) -> str:
    """A fixed text with SQL in place of the names in braces."""
    return "(" + " || ".join(f"({sql[x]})" if i % 2 else q(x) for i, x in enumerate(parts_of(template)) if i % 2 or x) + ")"


def num(value: float) -> str:
    return f"'{value!r}'::DOUBLE"


def rx(column: str, pattern: Pattern) -> str:
    return f"regexp_matches({column}, {q(pattern.re2)})"


def case(key: str, pairs: list[tuple], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs) + f" ELSE {default} END"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(v if isinstance(v, _Raw) else q(v) for v in row) + ")" for row in rows) + ")"


class _Raw(str):
    """SQL that is already written."""


def listed(items: list[str]) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


SNIP = values("snip", "snippet_id, filename, content", [(i, f, c) for i, (f, c) in enumerate(SNIPPETS)])


def _ext(name: str) -> str:
    return rf"lower(regexp_extract({name}, '(?s)(\.[^.]+)\z', 1))"


def language_case(field: int, content: str, filename: str) -> str:
    """field: 0 name, 1 confidence, 2 how."""
    pick = lambda *v: num(v[1]) if field == 1 else q(v[field])
    out = [f"WHEN coalesce({filename}, '') <> '' AND {_ext(filename)} = {q(e)} THEN {pick(n, c, 'extension')}" for e, n, c in L.EXTENSIONS]
    out.append(f"WHEN lower({filename}) = 'dockerfile' OR lower({filename}) LIKE '%/dockerfile' THEN {pick('Dockerfile', L.DOCKERFILE_CONFIDENCE, 'extension')}")
    text = f"substring({content}, 1, {L.SAMPLE})"
    out += [f"WHEN starts_with({text}, '#!') AND {rx(text, Pattern(p))} THEN {pick(n, L.SHEBANG_CONFIDENCE, 'shebang')}" for p, n in L.SHEBANGS]
    for n, c, strong, weak in L.HEURISTICS:
        out.append("WHEN " + " AND ".join(rx(text, Pattern(*p)) for p in strong) + f" THEN {pick(n, c, 'syntax-heuristic')}")
        out.append("WHEN " + " OR ".join(rx(text, Pattern(*p)) for p in weak) + f" THEN {pick(n, c * L.WEAK_FACTOR, 'keyword')}")
    return "CASE " + " ".join(out) + f" ELSE {pick('Unknown', L.UNKNOWN_CONFIDENCE, 'fallback')} END"


def _ruled(prefix: str, rules: list[tuple], text: str, bonus) -> tuple[str, str, str]:
    """Columns for scores, for the best, and for the best rule's signals."""
    scores, names, signals = [], [], []
    for i, (name, base, step, most, patterns) in enumerate(rules):
        count = " + ".join(f"({rx(text, Pattern(p))})::INT" for p, _ in patterns)
        plain = f"least({num(most)}, {num(base)} + (({count}) - 1) * {num(step)})"
        scores.append(f"CASE WHEN ({count}) > 0 THEN {bonus(name, most, plain)} END AS {prefix}{i}")
        names.append(f"WHEN {prefix}{i} = {prefix}_conf THEN {q(name)}")
        signals.append(f"WHEN {prefix}{i} = {prefix}_conf THEN {listed([f'CASE WHEN {rx(text, Pattern(p))} THEN {q(label)} END' for p, label in patterns])}")
    return ", ".join(scores), "CASE " + " ".join(names) + " END", "CASE " + " ".join(signals) + " END"


def _framework_bonus(name, most, plain):
    if name != "Next.js":
        return plain
    return f"CASE WHEN lower(filename) IN ({', '.join(map(q, W.NEXT_ROUTE_FILES))}) THEN least({num(W.NEXT_ROUTE_CAP)}, {plain} + {num(W.NEXT_ROUTE_BONUS)}) ELSE {plain} END"


def _runtime_bonus(name, most, plain):
    arms = ""
    for runtime, how, part, bonus in T.FILENAME_BONUS:
        if runtime == name:
            test = f"contains(lower(filename), {q(part)})" if how == "contains" else f"ends_with(lower(filename), {q(part)})"
            arms += f" WHEN {test} THEN least({num(T.BONUS_CAP)}, {plain} + {num(bonus)})"
    return f"least({num(most)}, CASE{arms} ELSE {plain} END)" if arms else f"least({num(most)}, {plain})"


def trimmed(text: str) -> str:
    return rf"regexp_replace({text}, '\A[{SPACE}]+|[{SPACE}]+\z', '', 'g')"


def understanding() -> str:
    """CTEs up to u: one row for each snippet with everything understand() finds."""
    fw, fw_name, fw_signals = _ruled("fw", W.RULES, "s3", _framework_bonus)
    rt, rt_name, rt_signals = _ruled("rt", T.RULES, "s3", _runtime_bonus)
    art, art_names = [], []
    for i, (kind, base, step, most, names, patterns) in enumerate(A.RULES):
        named = " OR ".join(rx("coalesce(filename, '')", Pattern(*p)) for p in names)
        count = " + ".join(f"({rx('s3', Pattern(*p))})::INT" for p in patterns)
        art.append(f"greatest(CASE WHEN coalesce(filename, '') <> '' AND ({named}) THEN {num(base + A.FILENAME_BONUS)} END, CASE WHEN ({count}) > 0 THEN least({num(most)}, {num(base)} + (({count}) - 1) * {num(step)}) END) AS art{i}")
        art_names.append(f"WHEN art{i} = art_best THEN {q(kind)}")
    signals = [f"CASE WHEN {' OR '.join(rx('content', Pattern(p, f)) for p, f, _ in rows)} THEN {{'name': {q(name)}, 'evidence': CASE " + " ".join(f"WHEN {rx('content', Pattern(p, f))} THEN {q(e)}" for p, f, e in rows) + " END} END" for name, rows in S.RULES]
    deps = []
    for p, f, languages in S.DEPENDENCIES:
        found = f"regexp_extract_all(content, {q(Pattern(p, f).re2)}, 1)"
        gate = " OR ".join(f"contains(lower(lang_name), {q(x.lower())})" for x in languages)
        deps.append(f"CASE WHEN {gate} THEN {found} ELSE [] END" if languages else found)
    weights = " + ".join(f"coalesce({c}, {num(Q.ABSENT)}) * {num(w)}" for c, (_, w) in zip(("lang_conf", "fw_conf", "rt_conf", "art_conf"), Q.WEIGHTS, strict=True))
    asked = {
        1: "lang_conf < '0.55'::DOUBLE", 2: "fw_name IS NULL AND lang_conf > '0.5'::DOUBLE AND (contains(lang_name, 'TypeScript') OR contains(lang_name, 'JavaScript') OR contains(lang_name, 'Python'))",
        3: "rt_type IS NULL OR (rt_conf < '0.65'::DOUBLE AND rt_type <> 'edge')", 4: "list_contains(list_transform(signals, lambda s: s.name), 'authentication') AND fw_name IS NULL",
        5: "list_contains(list_transform(signals, lambda s: s.name), 'database') AND coalesce(fw_name, '') NOT IN ('Prisma', 'Mongoose')",
        6: "art_type IS NULL AND overall < '0.7'::DOUBLE", 7: "overall < '0.5'::DOUBLE",
    }
    questions = listed([f"CASE WHEN {asked[p]} THEN {q(text)} END" for p, text, _ in Q.QUESTIONS])
    return f"""{SNIP},
a0 AS (SELECT *, substring(content, 1, 3000) AS s3, {', '.join(f"{language_case(i, 'content', 'filename')} AS lang_{n}" for i, n in enumerate(('name', 'conf', 'via')))} FROM snip),
a1 AS (SELECT *, {fw}, {rt}, {', '.join(art)} FROM a0),
a2 AS (SELECT *, greatest({', '.join(f'fw{i}' for i in range(len(W.RULES)))}) AS fw_conf, greatest({', '.join(f'rt{i}' for i in range(len(T.RULES)))}) AS rt_conf, greatest({', '.join(f'art{i}' for i in range(len(A.RULES)))}) AS art_best FROM a1),
a3 AS (SELECT snippet_id, filename, content, lang_name, lang_conf, lang_via, fw_conf, {fw_name} AS fw_name, {fw_signals} AS fw_signals, rt_conf, {rt_name} AS rt_type, {rt_signals} AS rt_signals,
  CASE {' '.join(art_names)} END AS art_type, CASE WHEN art_best IS NOT NULL THEN least({num(A.FINAL_CAP)}, art_best) END AS art_conf, {listed(signals)} AS signals, list_filter(list_transform({' || '.join(deps)}, lambda d: {trimmed('d')}), lambda d: d <> '') AS found FROM a2),
a4 AS (SELECT * EXCLUDE (found), list_filter(found, lambda x, i: list_position(found, x) = i) AS deps, {weights} AS raw FROM a3),
a5 AS (SELECT *, least(1.0, (((raw * '1152921504606846976'::DOUBLE)::BIGINT::HUGEINT * 1000 + 576460752303423488) // 1152921504606846976)::DOUBLE / 1000) AS overall, raw < {num(Q.CLARIFY_BELOW)} AS clarify FROM a4),
u AS (SELECT *, CASE WHEN clarify THEN list_slice({questions}, 1, {Q.MOST}) ELSE [] END AS questions,
  concat_ws(' ', coalesce({case('art_type', A.LABELS, 'art_type')}, 'Code file'), 'in ' || lang_name, 'using ' || fw_name, '(' || {case('rt_type', T.LABELS, 'rt_type')} || ' runtime)',
    '· ' || floor(overall * 100 + 0.5)::BIGINT || '% confidence' || CASE WHEN clarify THEN ' — clarification needed' ELSE '' END) AS summary FROM a5)"""


def grounding() -> str:
    """CTEs after u: g (framework to ground), g2 (versions), g3 (APIs), g5 (sources), g6 (merged), roll (roll-up)."""
    indicators = [(b, i, f, label, Pattern(*p).re2, f"{p[0][: G.SIGNAL_CHARS]} → {label}") for b, (f, label, _, _, _, pats) in enumerate(G.BRACKETS) for i, p in enumerate(pats)]
    library = "CASE " + " ".join(f"WHEN starts_with(d, {q(k)}) THEN {q(n)}" if k.endswith("/") else f"WHEN d = {q(k)} THEN {q(n)}" for k, n in G.LIBRARIES) + " END"
    question = " ".join(f"WHEN framework = {q(f)} AND contains(label, {q(part)}) THEN {q(text)}" for f, part, text in Q.VERSION_VARIANTS)
    for f, text in Q.VERSION_QUESTIONS:
        before, mark, after = text.partition("{label}")
        question += f" WHEN framework = {q(f)} THEN {q(before)} || label || {q(after)}" if mark else f" WHEN framework = {q(f)} THEN {q(text)}"
    known = ", ".join(map(q, G.FRAMEWORKS))
    return f"""{values('indicator', 'b, i, framework, label, pattern, shown', indicators)},
{values('bracket', 'b, label, minv, maxv, base', [(b, x[1], x[2], x[3], _Raw(num(G.BASE + x[4]))) for b, x in enumerate(G.BRACKETS)])},
{values('api', 'a, framework, api, introduced, deprecated, description, pattern', [(i, *x, api_pattern(x[1]).re2) for i, x in enumerate(G.APIS)])},
{values('source', 's, framework, version, priority, label, url, purpose', [(i, *x) for i, x in enumerate(G.SOURCES)])},
g0 AS (SELECT snippet_id, content, list_filter([fw_name] || list_transform(deps, lambda d: {library}), lambda x: x IS NOT NULL) AS every FROM u),
gl AS (SELECT snippet_id, content, list_filter(every, lambda x, i: list_position(every, x) = i) AS names FROM g0),
g AS (SELECT snippet_id, content, unnest(names) AS framework, generate_subscripts(names, 1) AS ord FROM gl),
m AS (SELECT g.snippet_id, g.ord, i.b, count(*) AS n, string_agg(i.shown, '|' ORDER BY i.i) AS shown FROM g JOIN indicator i ON i.framework = g.framework AND regexp_matches(g.content, i.pattern) GROUP BY ALL),
ms AS (SELECT m.*, b.label, b.minv, b.maxv, least({num(G.MOST)}, b.base + (n - 1) * {num(G.STEP)}) AS score FROM m JOIN bracket b ON m.b = b.b),
mr AS (SELECT *, coalesce(max(score) OVER (PARTITION BY snippet_id, ord ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM ms),
mb AS (SELECT snippet_id, ord, arg_max(label, b) AS label, arg_max(coalesce(minv, ''), b) AS minv, arg_max(coalesce(maxv, ''), b) AS maxv, arg_max(score, b) AS score, string_agg(shown, '|' ORDER BY b) AS signals FROM mr WHERE score > prior GROUP BY ALL),
g2 AS (SELECT g.snippet_id, g.ord, g.framework, nullif(minv, '') AS min_version, nullif(maxv, '') AS max_version, coalesce(signals, '') AS signals,
  CASE WHEN label IS NOT NULL THEN label WHEN framework IN ({known}) THEN framework || ' (version undetermined from code)' ELSE framework || ' (version unknown)' END AS label,
  CASE WHEN label IS NOT NULL THEN score WHEN framework IN ({known}) THEN {num(G.UNDETERMINED)} ELSE {num(G.UNKNOWN)} END AS confidence FROM g LEFT JOIN mb USING (snippet_id, ord)),
g3 AS (SELECT g.snippet_id, g.ord, a.* EXCLUDE (framework, pattern), a.framework FROM g JOIN api a ON (a.framework = g.framework OR g.framework NOT IN ({known})) AND regexp_matches(g.content, a.pattern)),
g5a AS (SELECT g2.snippet_id, g2.ord, s.s, s.priority, s.label, s.url, s.purpose, (s.version IS NULL)::INT AS late FROM g2 JOIN source s ON s.framework = g2.framework AND (s.version IS NULL OR s.version = g2.label)),
g5b AS (SELECT *, row_number() OVER (PARTITION BY snippet_id, ord, url ORDER BY late, s) AS r FROM g5a),
g5 AS (SELECT snippet_id, ord, label, url, priority, purpose, row_number() OVER (PARTITION BY snippet_id, ord ORDER BY priority, late, s) AS place FROM g5b WHERE r = 1),
g6b AS (SELECT *, row_number() OVER (PARTITION BY snippet_id, url ORDER BY ord, place) AS r FROM g5),
g6 AS (SELECT snippet_id, label, url, priority, purpose, row_number() OVER (PARTITION BY snippet_id ORDER BY priority, ord, place) AS place FROM g6b WHERE r = 1),
g8 AS (SELECT *, CASE WHEN confidence >= {num(Q.VERSION_BELOW)} THEN NULL {question} END AS question FROM g2),
g9b AS (SELECT *, row_number() OVER (PARTITION BY snippet_id, framework, api ORDER BY ord, a) AS r FROM g3),
apis AS (SELECT snippet_id, string_agg(framework || '::' || api, '|' ORDER BY ord, a) AS apis, string_agg('- [' || framework || '] ' || api || ' (Introduced: ' || introduced || ')' || coalesce(' (DEPRECATED in ' || deprecated || ')', '') || ' - ' || description, chr(10) ORDER BY ord, a) AS api_text FROM g9b WHERE r = 1 GROUP BY ALL),
srcs AS (SELECT snippet_id, count(*) AS n, string_agg(url, '|' ORDER BY place) AS urls, string_agg('- ' || label || ' - ' || url || ' (' || purpose || ')', chr(10) ORDER BY place) AS source_text FROM g6 GROUP BY ALL),
asks AS (SELECT snippet_id, question, min(ord) AS ord FROM g8 WHERE question IS NOT NULL GROUP BY ALL),
ask AS (SELECT snippet_id, array_to_string(list_slice(list(question ORDER BY ord), 1, {Q.VERSION_MOST}), '|') AS asked FROM asks GROUP BY ALL),
vers AS (SELECT snippet_id, string_agg(framework, ', ' ORDER BY ord) AS names, string_agg(label, ', ' ORDER BY ord) FILTER (confidence >= {num(G.SUMMARY_LEAST)}) AS labels, bool_or(confidence < {num(Q.VERSION_BELOW)}) AS doubtful, string_agg('- ' || framework || ': ' || label, chr(10) ORDER BY ord) AS version_text FROM g2 GROUP BY ALL),
roll AS (SELECT u.snippet_id, coalesce(apis, '') AS apis, coalesce(urls, '') AS urls, coalesce(asked, '') AS asked, coalesce(doubtful, false) OR asked IS NOT NULL AS requires, api_text, source_text, version_text,
  CASE WHEN names IS NULL THEN {q(G.NOTHING_TO_GROUND)} ELSE coalesce(labels, names || ' (versions undetermined)') || ' ' || CASE WHEN srcs.n > 0 THEN '— ' || srcs.n || ' grounding source' || CASE WHEN srcs.n <> 1 THEN 's' ELSE '' END || ' ready' ELSE '— no grounding sources available' END END AS summary_line
  FROM u LEFT JOIN apis USING (snippet_id) LEFT JOIN srcs USING (snippet_id) LEFT JOIN ask USING (snippet_id) LEFT JOIN vers USING (snippet_id))"""


def over_parts(ctes: str, select: str, source: str, where: str = "") -> str:
    """A snippet's result for every part that carries it."""
    return f"WITH {ctes} SELECT p_partkey AS artifact_id, {select} FROM part JOIN {source} x ON p_partkey % {len(SNIPPETS)} = x.snippet_id {where}"


def context_sql() -> str:
    signal_lines = "array_to_string(list_transform(signals, lambda s: s.name || ' (Evidence: ' || s.evidence || ')'), chr(10))"
    return filled(
        X.UNDERSTANDING, summary="summary", framework="coalesce(fw_name, 'None/Unknown')", runtime="coalesce(rt_type, 'Unknown')", artifact="coalesce(art_type, 'Unknown')",
        dependencies="CASE WHEN len(deps) > 0 THEN array_to_string(deps, ', ') ELSE 'None' END", signals=f"CASE WHEN len(signals) > 0 THEN {signal_lines} ELSE 'None' END",
        versions="coalesce(version_text, '- None')", apis="coalesce(api_text, '- None')", sources="coalesce(source_text, '- None')",
    )


def lookup_case(column: str, pairs: list[tuple], default: str) -> str:
    return case(column, pairs, default)


def size_text(size: str) -> str:
    return f"CASE WHEN {size} < 1024 THEN {size} || ' B' WHEN {size} < 1048576 THEN printf('%.1f', round({size} / 1024.0::DOUBLE, 1)) || ' KB' ELSE printf('%.1f', round({size} / 1048576.0::DOUBLE, 1)) || ' MB' END"


def escaped(text: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = f"replace({text}, {q(a)}, {q(b)})"
    return text


def unescaped(text: str, quotes: bool = True) -> str:
    for b, a in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")] + ([("&quot;", '"'), ("&#39;", "'")] if quotes else []):
        text = f"replace({text}, {q(b)}, {q(a)})"
    return text


def severity_of(key: str) -> str:
    return f"['critical', 'high', 'medium', 'low', 'odd'][({key} % 5 + 1)::INT]"


def category_of(key: str) -> str:
    return f"[{', '.join(map(q, R.CATEGORIES))}][({key} % 6 + 1)::INT]"
