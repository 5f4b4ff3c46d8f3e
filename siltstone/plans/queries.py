"""One query for each operator, over the driver's tables.

Source texts come from the derived corpus; findings are stand-ins derived from
lineitem (artifact = order, category and severity by line and part number).
Arrays are joined to text so that results compare as plain values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import classify as C
from siltstone.operators import confidence as K
from siltstone.operators import containment as J1
from siltstone.operators import conversation as M
from siltstone.operators import extract as E
from siltstone.operators import findings as J
from siltstone.operators import grounding as G
from siltstone.operators import ingest as I
from siltstone.operators import limits as R1
from siltstone.operators import progress as R2
from siltstone.operators import states as R4
from siltstone.operators import store as S5
from siltstone.plans import sql as Q
from siltstone.plans.corpus import artifacts, spread
from siltstone.rules import language as L
from siltstone.rules import limits as R
from siltstone.rules import registry as REG
from siltstone.rules import texts as T
from siltstone.sources.readers import read_requests

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if it has one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(array: Column, sep: str = "|") -> Column:
    return F.array_join(array, sep)


_U = Q.understanding()
_G = _U + ",\n" + Q.grounding()
_FINDING = f"SELECT l_orderkey AS artifact_id, l_linenumber AS idx, {Q.category_of('l_linenumber')} AS category, {Q.severity_of('l_partkey')} AS severity FROM lineitem"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, key: F.get(F.array(*[F.lit(n) for n in names]), key.cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("artifact_id"), F.col("l_linenumber").alias("idx"), "l_partkey",
        pick(R.CATEGORIES, F.pmod("l_linenumber", F.lit(6))).alias("category"), pick(["critical", "high", "medium", "low", "odd"], F.pmod("l_partkey", F.lit(5))).alias("severity"),
    )


def _large(what: str, size: str, limit: int) -> str:
    return Q.filled(T.TOO_LARGE, what=Q.q(what), size=f"printf('%.1f', round({size} / 1048576.0::DOUBLE, 1))", limit=f"'{limit}.0'")


# --- validation -----------------------------------------------------------


@query(f"""WITH s AS (SELECT doc_id, strlen(text) * 1500 AS n FROM documents) SELECT doc_id, NOT n > {R.MAX_UPLOAD_BYTES} AS valid,
CASE WHEN n > {R.MAX_UPLOAD_BYTES} THEN {_large('File', 'n', 5)} END AS error FROM s""")
def v1_upload_size(spark, sf_dir):
    """V1; sizes are the texts' bytes times 1500, so that both outcomes occur."""
    return table(spark, sf_dir, "documents").select("doc_id", I.upload_size(X.byte_size(F.col("text")) * 1500).alias("v")).select("doc_id", "v.*")


_FILES = [("a.ts", ""), ("b.PNG", "image/png"), ("vue", ""), ("README", "text/plain"), ("x.py", ""), ("y.js", "video/mp4"), ("noext", None), ("a.b.JSX", "application/octet-stream")]


@query(f"""WITH {Q.values('f', 'k, name, mime', [(i, *x) for i, x in enumerate(_FILES)])},
e AS (SELECT p_partkey AS part_id, lower(name) AS low, coalesce(mime, '') AS mime, lower(regexp_extract(name, '(?s)(\\.?[^.]*)\\z', 1)) AS ext FROM part JOIN f ON p_partkey % {len(_FILES)} = k),
t AS (SELECT *, starts_with(mime, 'image/') OR starts_with(mime, 'video/') OR starts_with(mime, 'audio/') AS media,
  ext IN ('.js','.ts','.jsx','.tsx','.vue','.svelte') OR '.' || low IN ('.js','.ts','.jsx','.tsx','.vue','.svelte') OR mime IN ('text/plain','text/javascript','application/javascript','application/typescript') AS ok FROM e)
SELECT part_id, ok AND NOT media AS valid, CASE WHEN media THEN {Q.q(T.MULTIMEDIA)}
WHEN NOT ok THEN {Q.filled(T.UNSUPPORTED, extension="coalesce(nullif(ext, ''), 'unknown')")} END AS error FROM t""")
def v2_upload_type(spark, sf_dir):
    files = spark.createDataFrame([(i, *x) for i, x in enumerate(_FILES)], "k int, name string, mime string")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.pmod("p_partkey", F.lit(len(_FILES))).cast("int").alias("k")).join(F.broadcast(files), "k")
    return rows.select("part_id", I.upload_type(F.col("name"), F.col("mime")).alias("v")).select("part_id", "v.*")


@query("""SELECT page_id, NOT strlen(repeat(html, 100)) > 1048576 AS valid FROM pages""")
def v3_paste_size(spark, sf_dir):
    """V3; pages repeated a hundred times."""
    return table(spark, sf_dir, "pages").select("page_id", I.paste_size(F.repeat("html", F.lit(100)))["valid"].alias("valid"))


@query(f"""WITH h AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE (o_orderkey * 3000)::VARCHAR END AS header FROM orders)
SELECT o_orderkey, coalesce(try_cast(header AS DOUBLE) <= {R.MAX_REQUEST_BYTES}, true) AS passes FROM h""")
def v4_request_size(spark, sf_dir):
    header = F.when(F.pmod("o_orderkey", F.lit(4)) == 1, "x").when(F.pmod("o_orderkey", F.lit(4)) > 1, (F.col("o_orderkey") * 3000).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", I.request_size(header).alias("passes"))


@query(f"SELECT doc_id, coalesce(length(nullif(text, '')) BETWEEN 1 AND {R.MAX_CONTENT_CHARS}, false) AS valid FROM documents")
def v5_review_body(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", I.review_body(F.col("text")).alias("valid"))


@query("SELECT conv_id, count(*) AS turns, count(*) BETWEEN 1 AND 50 AND bool_and(coalesce(role, '') IN ('user', 'assistant', 'system')) AS valid FROM conversations GROUP BY conv_id")
def v6_chat_body(spark, sf_dir):
    return I.chat_body(table(spark, sf_dir, "conversations"))


@query(f"WITH f AS ({_FINDING}), c AS (SELECT *, idx * 0.2::DOUBLE AS confidence FROM f) SELECT artifact_id, idx, severity <> 'odd' AND confidence BETWEEN 0 AND 1 AS valid FROM c")
def v7_finding_schema(spark, sf_dir):
    return findings(spark, sf_dir).select("artifact_id", "idx", I.finding_valid(F.col("category"), F.col("severity"), F.col("idx") * F.lit(0.2)).alias("valid"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 < 2 THEN repeat('😀', 15 + (doc_id % 20)::INT) ELSE coalesce(text, '') END AS t FROM documents), n AS (SELECT doc_id, length(t) + length(regexp_replace(t, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) >= 50 AS long FROM d)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'review_staged' WHEN long AND doc_id % 3 = 1 THEN 'reject' WHEN long AND doc_id % 3 = 0 THEN 'review_paste' ELSE 'chat' END AS target FROM n""")
def v9_routing(spark, sf_dir):
    """V9 over the documents as sent texts; two of seven are 15 to 34 emoji, each two units long."""
    third = F.col("doc_id") % 3
    emoji = F.repeat(F.lit("😀"), (F.col("doc_id") % 20 + 15).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", I.route(F.col("doc_id") % 5 == 0, F.when(F.col("doc_id") % 7 < 2, emoji).otherwise(F.coalesce("text", F.lit(""))), third == 0, third == 1).alias("target"))


@query(f"""WITH {Q.values('f', 'k, name, mime, problem', [(0, 'a.ts', '', None), (1, 'b.PNG', 'image/png', 'media'), (2, 'vue', '', None), (3, 'README', 'text/plain', None), (4, 'x.py', '', '.py'), (5, 'y.js', 'video/mp4', 'media'), (6, 'noext', None, 'noext'), (7, 'a.b.JSX', 'application/octet-stream', None)])},
d AS (SELECT doc_id, name, problem, strlen(text) * 1500 AS size, CASE WHEN doc_id % 11 = 3 THEN NULL ELSE text END AS content FROM documents JOIN f ON doc_id % 8 = k),
e AS (SELECT *, CASE WHEN size > {R.MAX_UPLOAD_BYTES} THEN {_large('File', 'size', 5)}
WHEN problem = 'media' THEN {Q.q(T.MULTIMEDIA)} WHEN problem IS NOT NULL THEN {Q.filled(T.UNSUPPORTED, extension='problem')} WHEN content IS NULL THEN {Q.filled(T.UNREADABLE, name='name')} END AS error FROM d)
SELECT doc_id, error, error IS NULL AS staged, CASE name WHEN 'a.ts' THEN 'TypeScript' WHEN 'y.js' THEN 'JavaScript' WHEN 'x.py' THEN 'Python' WHEN 'a.b.JSX' THEN 'JavaScript / React' ELSE 'Unknown' END AS language, strlen(content)::INT AS byte_size FROM e""")
def s3_upload(spark, sf_dir):
    """S3 over the documents as uploaded files of eight names; sizes are the texts' bytes times 1500, every eleventh cannot be read."""
    files = spark.createDataFrame([(i, *x) for i, x in enumerate(_FILES)], "k int, filename string, mime string")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(len(_FILES))).cast("int").alias("k")).join(F.broadcast(files), "k")
    rows = rows.select("doc_id", "filename", "mime", (X.byte_size(F.col("text")) * 1500).alias("size"), F.when(F.col("doc_id") % 11 != 3, F.col("text")).alias("content"))
    return I.stage_upload(rows).select("doc_id", "error", "staged", "language", "byte_size")


@query(f"""WITH d AS (SELECT page_id, CASE WHEN page_id % 3 = 2 THEN repeat(html, 100) ELSE html END AS content, page_id % 5 AS g FROM pages),
e AS (SELECT *, CASE WHEN strlen(content) > 1048576 THEN {_large('Input', 'strlen(content)', 1)}
WHEN g >= 3 THEN {Q.q(T.NOT_CODE)} END AS error FROM d)
SELECT page_id, error, error IS NULL AS staged, CASE g WHEN 0 THEN 'pasted-input.ts' WHEN 1 THEN 'mine.vue' WHEN 2 THEN 'pasted-component.tsx' ELSE 'pasted-snippet.txt' END AS filename,
CASE g WHEN 0 THEN 'TypeScript' WHEN 1 THEN 'Vue' WHEN 2 THEN 'TypeScript / React' ELSE 'Plain Text' END AS language, 'paste' AS source FROM e""")
def s2_paste(spark, sf_dir):
    """S2 over the pages as pasted texts, every third a hundred times as long; guesses go by page_id."""
    kind = F.pmod("page_id", F.lit(5))
    guess = F.when(kind == 0, "typescript").when(kind == 1, "javascript").when(kind == 2, "xml").when(kind == 3, "rust").otherwise("typescript")
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 2, F.repeat("html", F.lit(100))).otherwise(F.col("html")).alias("content"), guess.alias("guess"), F.when(kind == 4, 1).otherwise(9).alias("relevance"), F.when(kind == 1, "mine.vue").alias("explicit"))
    return I.stage_paste(rows, explicit="explicit").select("page_id", "error", "staged", "filename", "language", "source")


_UNDERSTANDING = """{"language":{"name":"Go","confidence":1},"framework":null,"runtime":{"type":"node"},"artifactType":null,"dependencies":["a"],"architecturalSignals":[{"name":"x","evidence":"y"}],"overallConfidence":0.5,"requiresClarification":false,"clarificationQuestions":[],"summary":"s","versionGrounding":null}"""
_FOUND = """{"id":"1","title":"t","category":"c","severity":"s","explanation":"e","recommendation":"r","evidence":["l"]}"""
#: Bodies, the mode that each is read in, and whether it is valid.
_BODIES = [
    ('{"content":"x","understanding":U}', "review", True), ('{"mode":"review","content":"x","task":"t","understanding":U}', "review", True), ('{"mode":"other","content":"x","understanding":U}', "review", False),
    ('{"content":"","understanding":U}', "review", False), ('{"content":5,"understanding":U}', "review", False), ('{"content":"x"}', "review", False), ('{"content":"x","task":null,"understanding":U}', "review", False),
    ('{"content":"x","understanding":{"summary":"s"}}', "review", False), ("{not json", "review", False), (None, "review", False), ("[]", "review", False),
    ('{"mode":"chat","messages":[{"role":"user","content":"hi"}]}', "chat", True), ('{"mode":"chat","messages":[]}', "chat", False), ('{"mode":"chat","messages":[{"role":"robot","content":"hi"}]}', "chat", False),
    ('{"mode":"chat","messages":[{"role":"user","parts":[{"type":"text","text":"a"},{"type":"image"}]}],"findingContext":F}', "chat", True), ('{"mode":"chat","messages":[{"role":"user","parts":[{"text":"a"}]}]}', "chat", False),
    ('{"mode":"chat","messages":[{"role":"user"}],"findingContext":{"id":"1"}}', "chat", False), ('{"mode":"chat","messages":[' + ",".join(['{"role":"system"}'] * 50) + "]}", "chat", True), ('{"mode":"chat","messages":[' + ",".join(['{"role":"system"}'] * 51) + "]}", "chat", False),
]


@query(f"WITH {Q.values('b', 'k, mode, valid', [(i, m, int(v)) for i, (_, m, v) in enumerate(_BODIES)])} SELECT o_orderkey, mode, valid = 1 AS valid FROM orders JOIN b ON o_orderkey % {len(_BODIES)} = k")
def s4_requests(spark, sf_dir):
    """A fixed body for each order; what it must be read as is written beside it."""
    fill = lambda b: b and b.replace("U}", _UNDERSTANDING + "}").replace("F}", _FOUND + "}")
    bodies = spark.createDataFrame([(i, fill(b)) for i, (b, _, _) in enumerate(_BODIES)], "k int, value string")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(len(_BODIES))).cast("int").alias("k")).join(F.broadcast(bodies), "k")
    return read_requests(rows).select("o_orderkey", "request.mode", "request.valid")


# --- projections ----------------------------------------------------------


@query(Q.over_parts(Q.SNIP, f"coalesce({Q._ext('filename')}, '') AS extension, {Q.case(Q._ext('filename'), L.DISPLAY, repr('Unknown'))} AS display, strlen(content) AS byte_size, length(content) - length(replace(content, chr(10), '')) + 1 AS line_count, {Q.size_text('strlen(content)')} AS formatted_size, 'paste' AS source", "snip"))
def p1_p6_normalise(spark, sf_dir):
    rows = I.normalise(artifacts(spark, sf_dir), "paste")
    return rows.select("artifact_id", F.coalesce("extension", F.lit("")).alias("extension"), F.col("language").alias("display"), "byte_size", "line_count", "formatted_size", "source")


@query(f"SELECT doc_id, strlen(text) AS byte_size, {Q.size_text('strlen(text)')} AS formatted_size, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM documents")
def p3_p5_sizes(spark, sf_dir):
    size = X.byte_size(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", size.alias("byte_size"), X.human_size(size).alias("formatted_size"), X.line_count(F.col("text")).alias("line_count"))


@query(f"SELECT page_id, {Q.escaped('html')} AS escaped FROM pages")
def p7_escape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.escape_html(F.col("html")).alias("escaped"))


@query(f"WITH l AS (SELECT page_id AS artifact_id, regexp_split_to_array(html, '\\r?\\n') AS a FROM pages), e AS (SELECT artifact_id, unnest(a) AS raw, generate_subscripts(a, 1) AS num FROM l) SELECT artifact_id, num::INT AS num, {Q.escaped('raw')} AS code FROM e WHERE num <= 1000")
def p8_code_lines(spark, sf_dir):
    return I.code_lines(table(spark, sf_dir, "pages").withColumnsRenamed({"page_id": "artifact_id", "html": "content"}), shown=R.SHOWN_LINES)


@query("SELECT o_orderkey, floor(o_totalprice / 500000 * 100 + 0.5)::BIGINT || '%' AS shown, upper(coalesce(nullif(CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'high' END, ''), 'info')) AS label FROM orders")
def p9_p12_formats(spark, sf_dir):
    severity = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, "").when(F.pmod("o_orderkey", F.lit(3)) == 1, "high")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.percent(F.col("o_totalprice") / 500000).alias("shown"), X.severity_label(severity).alias("label"))


# --- classifiers and extractors -------------------------------------------


@query(Q.over_parts(_U, "lang_name AS name, lang_conf AS confidence, lang_via AS detected_via", "u"))
def c1_language(spark, sf_dir):
    return artifacts(spark, sf_dir).select("artifact_id", C.detect_language(F.col("content"), F.col("filename")).alias("x")).select("artifact_id", "x.*")


@query("SELECT doc_id, " + ", ".join(f"{Q.language_case(i, 'text', 'NULL::VARCHAR')} AS {n}" for i, n in enumerate(("name", "confidence", "detected_via"))) + " FROM documents")
def c1_language_documents(spark, sf_dir):
    """C1 by content alone over the documents' whole rows (it reads 1200 characters by definition)."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", C.detect_language(F.col("text"), F.lit(None).cast("string")).alias("x")).select("doc_id", "x.*")


@query(Q.over_parts(_U, "fw_name AS name, fw_conf AS confidence, array_to_string(fw_signals, '|') AS signals", "u"))
def c2_framework(spark, sf_dir):
    return artifacts(spark, sf_dir).select("artifact_id", C.detect_framework(F.col("content"), F.col("filename")).alias("x")).select("artifact_id", "x.name", "x.confidence", joined(F.col("x.signals")).alias("signals"))


@query(Q.over_parts(_U, "rt_type AS type, rt_conf AS confidence, array_to_string(rt_signals, '|') AS signals", "u"))
def c3_runtime(spark, sf_dir):
    return artifacts(spark, sf_dir).select("artifact_id", C.detect_runtime(F.col("content"), F.col("filename")).alias("x")).select("artifact_id", "x.type", "x.confidence", joined(F.col("x.signals")).alias("signals"))


@query(Q.over_parts(_U, "art_type AS type, art_conf AS confidence", "u"))
def c4_artifact(spark, sf_dir):
    return artifacts(spark, sf_dir).select("artifact_id", C.classify_artifact(F.col("content"), F.col("filename")).alias("x")).select("artifact_id", "x.type", "x.confidence")


@query(Q.over_parts(_U, "array_to_string(list_transform(signals, lambda s: s.name || '=' || s.evidence), '|') AS signals", "u"))
def e1_signals(spark, sf_dir):
    found = F.transform(E.extract_signals(F.col("content")), lambda s: F.concat(s["name"], F.lit("="), s["evidence"]))
    return artifacts(spark, sf_dir).select("artifact_id", joined(found).alias("signals"))


_OUTSIDE = "list_filter(deps, lambda d: NOT starts_with(d, '.') AND NOT starts_with(d, '@/') AND NOT starts_with(d, '~/'))"


@query(Q.over_parts(_U, f"array_to_string(deps, '|') AS dependencies, array_to_string({_OUTSIDE}, '|') AS outside", "u"))
def e2_e3_dependencies(spark, sf_dir):
    rows = artifacts(spark, sf_dir).withColumn("d", E.extract_dependencies(F.col("content"), C.detect_language(F.col("content"), F.col("filename"))["name"]))
    return rows.select("artifact_id", joined(F.col("d")).alias("dependencies"), joined(E.external_dependencies(F.col("d"))).alias("outside"))


_CHAT = "text || ' **note ' || turn || '** ```py' || chr(10) || 'print(' || turn || ')  ' || chr(10) || '``` then `x` ```open'"


@query(f"""WITH t AS (SELECT conv_id, turn, {_CHAT} AS t FROM conversations),
p AS (SELECT *, regexp_split_to_array(t, '{E.FENCE.re2}') AS plain, regexp_extract_all(t, '{E.FENCE.re2}', 1) AS langs, regexp_extract_all(t, '{E.FENCE.re2}', 2) AS bodies FROM t),
r AS (SELECT conv_id, turn, list_transform(plain, lambda x, i: CASE WHEN x <> '' THEN 'text::' || x ELSE '' END || CASE WHEN i <= len(bodies) THEN '#code:' || coalesce(nullif(langs[i], ''), 'text') || ':' || regexp_replace(bodies[i], '[{Q.SPACE}]+\\z', '') || '#' ELSE '' END) AS parts FROM p)
SELECT conv_id, turn, array_to_string(parts, '') AS segments FROM r""")
def e4_segments(spark, sf_dir):
    """E4 over the conversations, each text with a closed and an unclosed fence added."""
    seg = F.transform(E.content_segments(_chat_text()), lambda s: F.when(s["type"] == "code", F.concat(F.lit("#code:"), s["lang"], F.lit(":"), s["content"], F.lit("#"))).otherwise(F.concat(F.lit("text::"), s["content"])))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", joined(seg, "").alias("segments"))


def _chat_text() -> Column:
    turn = F.col("turn").cast("string")
    return F.concat(F.col("text"), F.lit(" **note "), turn, F.lit("** ```py\nprint("), turn, F.lit(")  \n``` then `x` ```open"))


@query(f"""WITH t AS (SELECT conv_id, turn, {_CHAT} AS t FROM conversations),
p AS (SELECT *, regexp_split_to_array(t, '{E.SPAN.re2}') AS plain, regexp_extract_all(t, '{E.SPAN.re2}', 0) AS marks FROM t),
f AS (SELECT conv_id, turn, flatten(list_transform(plain, lambda x, i: CASE WHEN i <= len(marks) THEN [x, marks[i]] ELSE [x] END)) AS parts FROM p)
SELECT conv_id, turn, array_to_string(list_transform(parts, lambda x: CASE WHEN starts_with(x, '**') AND ends_with(x, '**') THEN 'bold:' || substring(x, 3, greatest(length(x) - 4, 0))
WHEN starts_with(x, '`') AND ends_with(x, '`') THEN 'code:' || substring(x, 2, greatest(length(x) - 2, 0)) ELSE 'text:' || x END), '|') AS spans FROM f""")
def e5_spans(spark, sf_dir):
    spans = F.transform(E.inline_spans(_chat_text()), lambda s: F.concat(s["kind"], F.lit(":"), s["text"]))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", joined(spans).alias("spans"))


@query(Q.over_parts(_U, "overall, clarify, array_to_string(questions, '|') AS questions, summary", "u"))
def k1_k3_confidence(spark, sf_dir):
    rows = K.understand(artifacts(spark, sf_dir))
    return rows.select("artifact_id", F.col("overall_confidence").alias("overall"), F.col("requires_clarification").alias("clarify"), joined(F.transform("questions", lambda x: x["question"])).alias("questions"), "summary")


@query(f"WITH {_U} SELECT lang_name AS language, fw_name AS framework, count(*) AS n, avg(overall) AS mean_confidence FROM part JOIN u ON p_partkey % {len(Q.SNIPPETS)} = snippet_id GROUP BY ALL")
def corpus_rollup(spark, sf_dir):
    """Our own addition: counts and mean confidence by language and framework."""
    rows = K.understand(artifacts(spark, sf_dir))
    return rows.groupBy(F.col("language.name").alias("language"), F.col("framework.name").alias("framework")).agg(F.count(F.lit(1)).alias("n"), F.avg("overall_confidence").alias("mean_confidence"))


# --- version grounding ----------------------------------------------------


def grounded(spark, sf_dir) -> DataFrame:
    return G.ground(K.understand(artifacts(spark, sf_dir)))


def exploded(spark, sf_dir) -> DataFrame:
    rows = grounded(spark, sf_dir).select("artifact_id", F.posexplode("groundings").alias("pos", "x"))
    return rows.select("artifact_id", (F.col("pos") + 1).cast("long").alias("ord"), "x.*")


@query(Q.over_parts(_G, "x.ord, x.framework", "g"))
def g1_frameworks(spark, sf_dir):
    return exploded(spark, sf_dir).select("artifact_id", "ord", "framework")


@query(Q.over_parts(_G, "x.ord, x.framework, x.min_version, x.max_version, x.label, x.confidence, x.signals", "g2"))
def g2_versions(spark, sf_dir):
    return exploded(spark, sf_dir).select("artifact_id", "ord", "framework", "inference.min_version", "inference.max_version", "inference.label", "inference.confidence", joined(F.col("inference.signals")).alias("signals"))


@query(Q.over_parts(_G, "x.ord, x.framework, x.api, x.introduced, x.deprecated", "g3"))
def g3_apis(spark, sf_dir):
    return exploded(spark, sf_dir).select("artifact_id", "ord", F.explode("apis").alias("a")).select("artifact_id", "ord", "a.framework", "a.api", "a.introduced", "a.deprecated")


@query(f"WITH {_G}, d AS (SELECT snippet_id, a.api, a.deprecated FROM u JOIN api a ON a.deprecated IS NOT NULL AND regexp_matches(u.content, a.pattern)) SELECT p_partkey AS artifact_id, api, deprecated FROM part JOIN d ON p_partkey % {len(Q.SNIPPETS)} = snippet_id")
def g4_deprecated(spark, sf_dir):
    rows = artifacts(spark, sf_dir).select("artifact_id", F.explode(G.deprecated_apis(G.api_matches(F.col("content")))).alias("a"))
    return rows.select("artifact_id", "a.api", "a.deprecated")


@query(Q.over_parts(_G, "x.ord, x.place, x.label, x.url, x.priority, x.purpose", "g5"))
def g5_sources(spark, sf_dir):
    rows = exploded(spark, sf_dir).select("artifact_id", "ord", F.posexplode("sources").alias("pos", "s"))
    return rows.select("artifact_id", "ord", (F.col("pos") + 1).cast("long").alias("place"), "s.label", "s.url", "s.priority", "s.purpose")


@query(Q.over_parts(_G, "x.place, x.label, x.url, x.priority", "g6"))
def g6_merged_sources(spark, sf_dir):
    rows = grounded(spark, sf_dir).select("artifact_id", F.posexplode("grounding_sources").alias("pos", "s"))
    return rows.select("artifact_id", (F.col("pos") + 1).cast("long").alias("place"), "s.label", "s.url", "s.priority")


@query(Q.over_parts(_G, "x.label, x.url", "g6", "WHERE x.priority = 1"))
def g7_primary_sources(spark, sf_dir):
    return grounded(spark, sf_dir).select("artifact_id", F.explode(G.primary_sources(F.col("grounding_sources"))).alias("s")).select("artifact_id", "s.label", "s.url")


@query(Q.over_parts(_G, "x.ord, x.question", "g8", "WHERE x.question IS NOT NULL"))
def g8_version_questions(spark, sf_dir):
    return exploded(spark, sf_dir).select("artifact_id", "ord", "question").filter("question is not null")


@query(Q.over_parts(_G, "x.apis, x.urls, x.asked, x.requires, x.summary_line", "roll"))
def g9_g10_rollup(spark, sf_dir):
    apis = F.transform("detected_apis", lambda a: F.concat(a["framework"], F.lit("::"), a["api"]))
    return grounded(spark, sf_dir).select(
        "artifact_id", joined(apis).alias("apis"), joined(F.transform("grounding_sources", lambda s: s["url"])).alias("urls"), joined(F.col("version_questions")).alias("asked"),
        F.col("requires_version_clarification").alias("requires"), F.col("grounding_summary").alias("summary_line"),
    )


@query("WITH " + Q.values("api", "ord, framework, api, introduced, deprecated, description", [(i, *x) for i, x in enumerate(REG.APIS, 1)]) + " SELECT ord, framework, api, introduced, deprecated, description FROM api")
def g11_registry(spark, sf_dir):
    return G.registry_apis(spark)


@query(f"WITH {_G}, n AS (SELECT api.a, count(*) AS n FROM part JOIN snip ON p_partkey % {len(Q.SNIPPETS)} = snip.snippet_id JOIN api ON regexp_matches(snip.content, api.pattern) GROUP BY api.a) SELECT (api.a + 1)::INT AS ord, framework, api, introduced, deprecated, description, coalesce(n, 0)::BIGINT AS n_artifacts FROM api LEFT JOIN n USING (a)")
def g11_usage(spark, sf_dir):
    """G11 as data: the registry's rows, each with the number of artifacts that use its API."""
    return G.registry_usage(artifacts(spark, sf_dir), G.registry_apis(spark))


# --- findings -------------------------------------------------------------

_SCORED = f"""WITH f AS ({_FINDING}), a AS (SELECT artifact_id, count(*) AS n, sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END) AS d,
count(*) FILTER (category IN ('architecture','maintainability','general')) AS arch, count(*) FILTER (category = 'security') AS sec, count(*) FILTER (category IN ('scalability','performance')) AS scale FROM f GROUP BY 1),
s AS (SELECT o_orderkey AS artifact_id, coalesce(n, 0) AS n_findings, CASE WHEN n IS NULL THEN 100 ELSE greatest(10, 100 - d) END AS score, coalesce(arch, 0) AS arch_count, coalesce(sec, 0) AS sec_count, coalesce(scale, 0) AS scale_count FROM orders LEFT JOIN a ON o_orderkey = artifact_id)
SELECT artifact_id, n_findings, score::INT AS score, CASE WHEN n_findings = 0 THEN '—' {' '.join(f'WHEN score >= {m} THEN {Q.q(g)}' for m, g, _ in R.GRADES)} END AS grade,
CASE WHEN n_findings = 0 THEN {Q.q(R.WAITING)} {' '.join(f'WHEN score >= {m} THEN {Q.q(s)}' for m, _, s in R.GRADES)} END AS status, arch_count, sec_count, scale_count,
{', '.join(f"least(100, {b}_count / 5.0::DOUBLE * 100) AS {b}_width" for b in ('arch', 'sec', 'scale'))} FROM s"""


@query(_SCORED)
def a1_a3_scores(spark, sf_dir):
    return J.scores(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact_id")), findings(spark, sf_dir))


@query(f"WITH f AS ({_FINDING}) SELECT CASE category WHEN 'security' THEN 'sec' WHEN 'scalability' THEN 'scale' WHEN 'performance' THEN 'scale' ELSE 'arch' END AS bucket, count(*) AS n FROM f GROUP BY 1")
def a4_buckets(spark, sf_dir):
    return findings(spark, sf_dir).groupBy(J.bucket(F.col("category")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_G} SELECT p_partkey AS artifact_id, count(DISTINCT url) AS n FROM part LEFT JOIN g5 x ON p_partkey % {len(Q.SNIPPETS)} = x.snippet_id GROUP BY 1")
def a5_distinct_urls(spark, sf_dir):
    return grounded(spark, sf_dir).select("artifact_id", F.size("grounding_sources").cast("long").alias("n"))


_EVIDENCE = "CASE l_linenumber % 6 WHEN 0 THEN ['line ' || l_quantity::INT % 9] WHEN 1 THEN ['zzzzzz', 'export CONST'] WHEN 2 THEN [(l_quantity::INT % 9)::VARCHAR, 'L7'] WHEN 3 THEN ['return', 'import '] WHEN 4 THEN ['uses html5 tags'] ELSE []::VARCHAR[] END"
_PLACED = f"""{Q.SNIP}, f AS (SELECT l_orderkey AS artifact_id, l_linenumber AS idx, l_partkey, {_EVIDENCE} AS ev, {Q.severity_of('l_partkey')} AS severity FROM lineitem),
t AS (SELECT f.*, list_transform(regexp_split_to_array(content, '\\r?\\n'), lambda x: {Q.escaped('x')}) AS lines FROM f JOIN snip ON l_partkey % {len(Q.SNIPPETS)} = snippet_id),
p AS (SELECT *, list_filter(list_transform(ev, lambda e: coalesce(nullif(regexp_extract(e, '{J.LINE_WORD.re2}', 1), ''), nullif(regexp_extract(e, '{J.LINE_NUMBER.re2}', 1), ''))), lambda x: x IS NOT NULL)[1]::BIGINT AS named,
 list_transform(lines, lambda x: lower({Q.unescaped('x', False)})) AS plain FROM t),
e AS (SELECT *, coalesce(named, list_filter(list_transform(list_filter(ev, lambda e: length(e) > 5), lambda e: nullif(list_position(list_transform(plain, lambda x: contains(x, lower(e))), true), 0)), lambda x: x IS NOT NULL)[1]) AS line FROM p)"""


def placed(spark, sf_dir) -> DataFrame:
    """Findings with evidence, their artifact's lines, and the line found: J1."""
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    q9 = (F.col("l_quantity").cast("int") % 9).cast("string")
    kind = F.pmod("l_linenumber", F.lit(6))
    evidence = F.when(kind == 0, F.array(F.concat(F.lit("line "), q9))).when(kind == 1, lit("zzzzzz", "export CONST")).when(kind == 2, F.array(q9, F.lit("L7"))).when(kind == 3, lit("return", "import ")).when(kind == 4, lit("uses html5 tags")).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("artifact_id"), F.col("l_linenumber").alias("idx"), F.col("l_partkey"), evidence.alias("evidence"))
    rows = rows.withColumn("severity", F.get(lit("critical", "high", "medium", "low", "odd"), F.pmod("l_partkey", F.lit(5)).cast("int")))
    sources = artifacts(spark, sf_dir).select(F.col("artifact_id").alias("l_partkey"), J.source_lines(F.col("content")).alias("lines"))
    return rows.join(sources, "l_partkey").withColumn("line", J.evidence_line(F.col("evidence"), F.col("lines")))


@query(f"WITH {_PLACED} SELECT artifact_id, idx, line, CASE WHEN line BETWEEN 1 AND len(lines) THEN array_to_string(list_transform(lines[greatest(line - 1, 1):line + 1], lambda x: {Q.unescaped('x')}), chr(10)) ELSE array_to_string(ev, chr(10)) END AS snippet FROM e")
def j1_j2_places(spark, sf_dir):
    return placed(spark, sf_dir).select("artifact_id", "idx", "line", J.code_snippet(F.col("line"), F.col("evidence"), F.col("lines")).alias("snippet"))


@query(f"WITH {_PLACED} SELECT artifact_id, line, max({{'idx': idx, 'severity': severity}}).severity AS severity, 'f-' || max(idx) AS id FROM e WHERE line IS NOT NULL AND line <> 0 GROUP BY ALL")
def a6_pins(spark, sf_dir):
    return J.pins(placed(spark, sf_dir)).select("artifact_id", F.explode("pins").alias("line", "pin")).select("artifact_id", "line", "pin.severity", "pin.id")


@query(rf"""WITH e AS (SELECT item_id, unnest(a) AS evidence, generate_subscripts(a, 1) - 1 AS part FROM (SELECT item_id, regexp_split_to_array(text, '[.\n]') AS a FROM benchmark)),
t AS (SELECT 'd' AS kind, doc_id AS artifact_id, text FROM documents UNION ALL SELECT 'p', page_id, html FROM pages),
l AS (SELECT kind, artifact_id, unnest(a) AS raw, generate_subscripts(a, 1) AS num FROM (SELECT kind, artifact_id, regexp_split_to_array(text, '\r?\n') AS a FROM t)),
n AS (SELECT kind, artifact_id, num, lower({Q.unescaped(Q.escaped('raw'), False)}) AS plain FROM l)
SELECT item_id, part, kind, artifact_id, min(num) AS line FROM e JOIN n ON contains(plain, lower(evidence)) WHERE length(evidence) > 5 GROUP BY ALL""")
def j1_evidence_containment(spark, sf_dir):
    """J1 over whole texts: every sentence of `benchmark` as evidence, and the first line of each document and page that holds it."""
    parts = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "[.\n]", -1)).alias("part", "evidence"))
    texts = lambda name, key, text, kind: table(spark, sf_dir, name).select(F.struct(F.lit(kind).alias("kind"), F.col(key).alias("artifact_id")).alias("key"), J.plain_text(F.col(text)).alias("text"))
    held = J1.evidence_lines(parts, texts("documents", "doc_id", "text", "d").unionByName(texts("pages", "page_id", "html", "p")), "key")
    return held.select("item_id", "part", "key.kind", "key.artifact_id", "line")


# --- conversations and prompts --------------------------------------------


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN coalesce(text, '') || '!' WHEN turn % 3 = 1 THEN coalesce(text, '') ELSE '' END AS message FROM conversations""")
def m1_message_text(spark, sf_dir):
    """M1; every third turn has parts (one without text), every third only content, the rest neither."""
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    parts = F.when(F.col("turn") % 3 == 0, F.array(part("text", F.col("text")), part("image", F.lit("x")), part("text", F.lit("!"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", M.message_text(parts, F.when(F.col("turn") % 3 == 1, F.col("text"))).alias("message"))


@query(f"WITH c AS (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 3 THEN chr(9) || ' ' || chr(10) ELSE text END AS text FROM conversations) SELECT * FROM c WHERE role IN ('user', 'assistant') AND {Q.trimmed('coalesce(text, repr_empty)')} <> ''".replace("repr_empty", "''"))
def m2_normalised_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") % 4 == 3, "\t \n").otherwise(F.col("text")).alias("text"))
    return M.normalise_chat(rows)


_BLOCK = Q.filled(
    T.FINDING_CONTEXT, id="'f-' || conv_id", title="'t'", category="'security'", severity="'high'", explanation="'why'", recommendation="'do'",
    evidence=f"CASE conv_id % 2 WHEN 0 THEN '  - line 1' || chr(10) || '  - line 2' ELSE {Q.q(T.NO_EVIDENCE)} END", snippet=f"CASE conv_id % 3 WHEN 0 THEN {Q.filled(T.SNIPPET, snippet=Q.q('x = 1'))} ELSE '' END",
)


def _block() -> Column:
    even = F.col("conv_id") % 2 == 0
    evidence = F.when(even, F.array(F.lit("line 1"), F.lit("line 2"))).otherwise(F.array().cast("array<string>"))
    return M.finding_block({"id": F.concat(F.lit("f-"), F.col("conv_id").cast("string")), "title": F.lit("t"), "category": F.lit("security"), "severity": F.lit("high"), "explanation": F.lit("why"), "recommendation": F.lit("do"), "evidence": evidence, "snippet": F.when(F.col("conv_id") % 3 == 0, "x = 1")})


@query(f"WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role IN ('user', 'assistant') AND {Q.trimmed('text')} <> '') SELECT conv_id, turn, role, CASE WHEN r = 1 AND role = 'user' THEN {Q.filled(T.BEFORE_TURN, block=_BLOCK)} ELSE '' END || text AS text FROM c")
def m3_m4_context(spark, sf_dir):
    rows = M.normalise_chat(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return M.inject_context(rows, _block())


@query(f"WITH {_G}, j AS (SELECT u.*, roll.* EXCLUDE (snippet_id) FROM u JOIN roll USING (snippet_id)) SELECT p_partkey AS artifact_id, {Q.context_sql()} AS context FROM part JOIN j ON p_partkey % {len(Q.SNIPPETS)} = snippet_id")
def m5_m6_context_text(spark, sf_dir):
    return M.reasoning_context(grounded(spark, sf_dir)).select("artifact_id", M.context_text().alias("context"))


_TASKS = f"CASE p_partkey % 3 WHEN 0 THEN {Q.q(T.TASK)} WHEN 1 THEN 'audit' ELSE {Q.filled(T.INSISTED, correction=Q.q('it is Go'), task=Q.q(T.TASK))} END"


@query(f"""WITH {_U} SELECT p_partkey AS artifact_id, {Q.filled(T.TASK_LINE, task=_TASKS)} AS task_line,
'```' || coalesce(nullif(lower(split_part(split_part(summary, 'in ', 2), ' ', 1)), ''), 'text') || chr(10) || content || chr(10) || '```' AS fenced_source FROM part JOIN u ON p_partkey % {len(Q.SNIPPETS)} = snippet_id""")
def m7_m8_prompt(spark, sf_dir):
    third = F.col("artifact_id") % 3
    rows = M.reasoning_context(grounded(spark, sf_dir))
    task = M.review_task(F.when(third == 1, "audit"), F.when(third == 2, "it is Go"))
    return M.prompt_parts(rows, task).select("artifact_id", "task_line", "fenced_source")


@query(Q.over_parts(_U, """CASE WHEN len(deps) > 0 THEN array_to_string(deps, ', ') ELSE 'None detected' END AS frameworks, CASE WHEN len(signals) > 0 THEN array_to_string(list_transform(signals, lambda s: s.name), ', ') ELSE 'Standard' END AS architecture,
CASE WHEN p_partkey % 2 = 0 THEN '"audit"' ELSE '(No extra context provided)' END AS prompt""", "u"))
def m11_confirmation_card(spark, sf_dir):
    rows = K.understand(artifacts(spark, sf_dir))
    return rows.select("artifact_id", M.confirmation_card(F.when(F.col("artifact_id") % 2 == 0, "audit")).alias("x")).select("artifact_id", "x.*")


@query(f"WITH {_PLACED} SELECT artifact_id, idx, 'f-' || idx AS id, severity, nullif(CASE WHEN line BETWEEN 1 AND len(lines) THEN array_to_string(list_transform(lines[greatest(line - 1, 1):line + 1], lambda x: {Q.unescaped('x')}), chr(10)) ELSE array_to_string(ev, chr(10)) END, '') AS code_snippet FROM e")
def m9_follow_up(spark, sf_dir):
    snippet = F.nullif(J.code_snippet(F.col("line"), F.col("evidence"), F.col("lines")), F.lit(""))
    return placed(spark, sf_dir).select("artifact_id", "idx", F.concat(F.lit("f-"), F.col("idx").cast("string")).alias("id"), F.coalesce("severity", F.lit("info")).alias("severity"), snippet.alias("code_snippet"))


# --- state ----------------------------------------------------------------

_WINDOW, _MOST = 5 * 86_400_000, 2
_EVENT_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
_EVENT_MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))"


def requests(spark, sf_dir) -> DataFrame:
    at = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), at.alias("at_ms"), F.col("event_id").alias("request_id"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS at_ms, event_id AS request_id FROM events),
w AS (SELECT key, min(at_ms) AS s FROM e GROUP BY key UNION ALL SELECT w.key, min(e.at_ms) AS s FROM w JOIN e ON e.key = w.key AND e.at_ms >= w.s + {_WINDOW} GROUP BY w.key, w.s),
d AS (SELECT e.*, max(w.s) AS s FROM e JOIN w ON w.key = e.key AND w.s <= e.at_ms GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key, s ORDER BY at_ms, request_id) AS n FROM d)
SELECT key, at_ms, request_id, n <= {_MOST} AS allowed, greatest({_MOST} - n, 0)::INT AS remaining, CASE WHEN n > {_MOST} THEN {_WINDOW} - (at_ms - s) ELSE 0 END AS retry_after_ms FROM r""")
def r1_rate_limit(spark, sf_dir):
    return R1.rate_limit(requests(spark, sf_dir), _WINDOW, _MOST)


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'pasted-input.ts' WHEN 1 THEN 'pasted-component.tsx' ELSE 'pasted-snippet.txt' END AS filename,
CASE o_orderkey % 4 WHEN 0 THEN 'TypeScript' WHEN 1 THEN 'TSX / JSX' WHEN 2 THEN 'Rust' ELSE 'Unknown / Plain Text' END AS language,
CASE o_orderkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '.txt' END AS extension, o_orderkey % 4 IN (0, 1) AS supported, o_orderkey % 4 = 2 AS unsupported FROM orders""")
def x1_paste_name(spark, sf_dir):
    kind = F.pmod("o_orderkey", F.lit(4))
    guess = F.when(kind == 0, "typescript").when(kind == 1, "xml").when(kind == 2, "rust").otherwise("go")
    return table(spark, sf_dir, "orders").select("o_orderkey", I.paste_name(guess, F.when(kind == 3, 1).otherwise(9)).alias("x")).select("o_orderkey", "x.*")


@query("SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY conv_id")
def r3_run_once(spark, sf_dir):
    """R3 in batch: the first submission of each review."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("turn"))


#: Characters in a chunk of a review.
_CHUNK = 40
_HEAD = """'{"summary":"' || o_orderpriority || ' \\"severity\\":\\"critical\\" [{","findings":[{"title":"' || o_orderstatus || ' \\\\","category":"performance","severity":"low"}'"""
_LINE = """',{"id":' || l_linenumber || ',"title":"part \\"' || l_partkey || '\\" {é]","category":"' || category || '","evidence":["' || l_returnflag || ' \\\\","' || l_linestatus || '"],"severity":"' || severity || '"}'"""
_FOOT = """'],"clarificationQuestions":["is \\"]}\\" right?"]}'"""
_LINE_AT = "((l_linenumber::BIGINT * 1000000 + l_partkey) * 10000 + l_suppkey) * 100 + l_quantity::BIGINT"


def review_chunks(spark, sf_dir) -> DataFrame:
    """Each order's findings as one JSON object, cut into chunks: a head and a foot from the order, a finding from each line."""
    rows, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    pick = lambda names, key: F.get(F.array(*[F.lit(n) for n in names]), key.cast("int"))
    rows = rows.withColumn("category", pick(R.CATEGORIES, F.pmod("l_linenumber", F.lit(6)))).withColumn("severity", pick(["critical", "high", "medium", "low", "odd"], F.pmod("l_partkey", F.lit(5))))
    lit = lambda sql: F.expr(sql.replace("\\", "\\\\"))
    at = ((F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")
    parts = rows.select(F.col("l_orderkey").alias("key"), at.alias("place"), lit(_LINE).alias("part"))
    for place, text in ((0, _HEAD), (10**14, _FOOT)):
        parts = parts.unionByName(order.select(F.col("o_orderkey").alias("key"), F.lit(place).cast("long").alias("place"), lit(text).alias("part")))
    pieces = parts.select("key", "place", "part", F.explode(F.sequence(F.lit(0), F.floor((F.length("part") - 1) / _CHUNK).cast("int"))).alias("i"))
    return pieces.select("key", (F.col("place") * 64 + F.col("i")).alias("at"), F.substring(F.col("part"), F.col("i") * _CHUNK + 1, F.lit(_CHUNK)).alias("text"))


@query(f"""WITH l AS (SELECT *, {Q.category_of('l_linenumber')} AS category, {Q.severity_of('l_partkey')} AS severity FROM lineitem),
p AS (SELECT l_orderkey AS key, {_LINE_AT} AS place, {_LINE} AS part, category, severity FROM l UNION ALL SELECT o_orderkey, 0, {_HEAD}, 'performance', 'low' FROM orders UNION ALL SELECT o_orderkey, {10**14}, {_FOOT}, NULL, NULL FROM orders),
d AS (SELECT *, CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END AS less FROM p),
b AS (SELECT *, count(severity) OVER w AS n0, coalesce(sum(less) FILTER (severity IS NOT NULL) OVER w, 0) AS d0, count(*) FILTER (category IN ('architecture','maintainability','general')) OVER w AS a0, count(*) FILTER (category = 'security') OVER w AS s0, count(*) FILTER (category IN ('scalability','performance')) OVER w AS c0
  FROM d WINDOW w AS (PARTITION BY key ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, unnest(range(0, (length(part) - 1) // {_CHUNK} + 1)) AS i FROM b),
e AS (SELECT *, least(length(part), (i + 1) * {_CHUNK}) AS stop, substring(part, 1, least(length(part), (i + 1) * {_CHUNK})) AS seen FROM c),
o AS (SELECT *, severity IS NOT NULL AND (place > 0 OR contains(seen, '"findings":[{{')) AS open, regexp_extract(seen, '"category":"([^"]*)', 1) AS kind, regexp_extract(replace(seen, '\\"severity', ''), '"severity":"([^"]*)', 1) AS how FROM e),
t AS (SELECT *, n0 + open::INT AS n, d0 + CASE WHEN open THEN CASE how WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END ELSE 0 END AS d FROM o)
SELECT key AS artifact_id, (place * 64 + i)::BIGINT AS at, n AS n_findings, n0 + (open AND stop = length(part))::INT AS n_complete, CASE WHEN n = 0 THEN 100 ELSE greatest(10, 100 - d) END::INT AS score,
  a0 + (open AND kind IN ('architecture','maintainability','general'))::INT AS arch_count, s0 + (open AND kind = 'security')::INT AS sec_count, c0 + (open AND kind IN ('scalability','performance'))::INT AS scale_count, place > 0 AND severity IS NULL AND stop = length(part) AS done FROM t""")
def r2_progressive_findings(spark, sf_dir):
    """R2 over every order's findings as JSON in chunks: the state after each chunk, the finding being written included."""
    return R2.progressive_findings(review_chunks(spark, sf_dir)).withColumnRenamed("key", "artifact_id")


_PATCHES = {
    "click": "{'stagedPayload': 'p' || event_id, 'validationError': NULL}", "view": "{'processingState': 'reading', 'x': NULL}", "error": "{'processingState': 'error', 'validationError': 'e' || event_id}",
    "purchase": "{'inputPayload': 'p' || event_id, 'processingResult': props, 'stagedPayload': NULL, 'processingState': 'done'}",
}
_STORED = ["stagedPayload", "inputPayload", "processingResult", "processingState", "validationError", "x"]


def _patch_fields(sql: str) -> list[tuple[str, str]]:
    return [tuple(x.strip() for x in part.replace("'", "", 2).split(":", 1)) for part in sql.strip("{}").split(", ")]


def _stored(field: str) -> str:
    """The value that the last patch with this field gave it: 'absent' before any, 'null' for a null."""
    arms = " ".join(f"WHEN '{kind}' THEN {{'v': {value}}}" for kind, sql in _PATCHES.items() for name, value in _patch_fields(sql) if name == field)
    first = "'absent'" if field not in S5.INITIAL else Q.q(S5.INITIAL[field] or "null")
    return f"coalesce(coalesce(last_value(CASE event_type {arms} END IGNORE NULLS) OVER w, {{'v': CASE WHEN {first} = 'null' THEN NULL ELSE {first} END}}).v, 'null') AS {field}"


@query(f"SELECT user_id, event_id, {', '.join(map(_stored, _STORED))} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def s5_store(spark, sf_dir):
    """Every user's store after each event; an event is a patch of some fields by its type, other types patch nothing."""
    rows = table(spark, sf_dir, "events")
    patch = F.lit(None).cast(S5.PATCH)
    for kind, sql in _PATCHES.items():
        pairs = ", ".join(f"'{name}', cast({value} AS string)" for name, value in _patch_fields(sql))
        patch = F.when(F.col("event_type") == kind, F.expr(f"map({pairs})")).otherwise(patch)
    patches = rows.select(F.col("user_id").alias("key"), F.expr(_EVENT_MS).alias("at"), F.struct(F.expr(_EVENT_US).alias("us"), F.col("event_id").alias("id")).alias("seq"), patch.alias("patch"))
    field = lambda n: F.when(F.map_contains_key("state", n), F.coalesce(F.element_at("state", n), F.lit("null"))).otherwise("absent").alias(n)
    return S5.store_states(patches).select(F.col("key").alias("user_id"), F.col("seq.id").alias("event_id"), *map(field, _STORED))


#: What an event does to a review: fixed states, or on to the next stage.
_MOVES = {"error": "fail", "purchase": "paste", "click": "read", "signup": "reset"}


@query(f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, ts, CASE event_type WHEN 'error' THEN 7 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 WHEN 'signup' THEN 0 END AS fixed FROM events),
g AS (SELECT *, count(fixed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM e),
n AS (SELECT *, coalesce(max(fixed) OVER (PARTITION BY user_id, part), 0) AS base, count(*) FILTER (fixed IS NULL) OVER (PARTITION BY user_id, part ORDER BY ts, event_id) AS steps FROM g),
s AS (SELECT *, CASE WHEN base = 7 THEN 7 ELSE least(base + steps, 6) END AS now FROM n),
b AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS was FROM s),
c AS (SELECT *, now <> was AS changed, max(CASE WHEN now <> was THEN ms END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS entered_ms FROM b),
d AS (SELECT *, lag(entered_ms) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM c)
SELECT user_id, event_id, [{', '.join(map(Q.q, R4.STATES))}][now + 1] AS state, [{', '.join(map(Q.q, R4.STATES))}][was + 1] AS before, changed, entered_ms, CASE WHEN changed THEN ms - prior END AS spent_ms FROM d""")
def r4_states(spark, sf_dir):
    """Every user's events as those of one review: the state after each, and how long the state it left was held."""
    event = F.lit("step")
    for kind, move in _MOVES.items():
        event = F.when(F.col("event_type") == kind, move).otherwise(event)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.expr(_EVENT_MS).alias("at"), F.struct(F.expr(_EVENT_US).alias("us"), F.col("event_id").alias("id")).alias("seq"), event.alias("event"))
    return R4.processing_states(rows).select(F.col("key").alias("user_id"), F.col("seq.id").alias("event_id"), "state", "before", "changed", "entered_ms", "spent_ms")
