"""Framework versions, API patterns and documentation sources of a source text.

The registry is a fixed table of seven frameworks. Everything stays within the
row: arrays and higher-order functions instead of a join and a regrouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.regex import Pattern, constant_rows, constants, escape, hits, let
from siltstone.rules import questions as Q
from siltstone.rules import registry as G

SOURCE = "array<struct<label:string,url:string,priority:int,purpose:string>>"
API = "array<struct<framework:string,api:string,introduced:string,deprecated:string,description:string>>"
INFERENCE = "struct<min_version:string,max_version:string,label:string,confidence:double,signals:array<string>>"


def api_pattern(api: str) -> Pattern:
    """G3's pattern text: a name that loses a double quote at either end is a directive in either quotes; () may follow spaces."""
    bare = api.removeprefix('"').removesuffix('"')
    bare = bare.removeprefix("'").removesuffix("'")
    if bare != api:
        return Pattern(f"[\"']{escape(bare)}[\"']")
    return Pattern(escape(api).replace(r"\(\)", r"\s*\("))


def frameworks_to_ground(framework: Column, dependencies: Column) -> Column:
    """G1: the detected framework, then libraries in dependency order, each once."""

    def library(d: Column) -> Column:
        out = None
        for key, name in G.LIBRARIES:
            hit = d.startswith(key) if key.endswith("/") else d == key
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out

    every = F.concat(F.array(framework), F.transform(dependencies, library))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))


def _infer(framework: str, found: Column) -> Column:
    """G2 for one framework: its brackets newest first, a later one taken only if it scores higher; found numbers the indicators that match."""
    rows, at, shown = [], 0, []
    for f, label, least, most, boost, indicators in G.BRACKETS:
        if f == framework:
            rows.append((G.BASE + boost, label, least, most, at, at + len(indicators)))
            shown += [f"{p[0][: G.SIGNAL_CHARS]} → {label}" for p in indicators]
        at += len(indicators)
    first, texts = rows[0][4], constants(shown)  # a framework's brackets stand together
    null, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    brackets = constant_rows(["base", "label", "min_version", "max_version", "low", "high"], rows)
    signals = lambda b: F.transform(F.filter(found, lambda x: (x >= b["low"]) & (x < b["high"])), lambda x: F.get(texts, x - first))
    rows = F.transform(brackets, lambda b: F.struct(*[b[c].alias(c) for c in ("base", "label", "min_version", "max_version")], signals(b).alias("signals")))
    start = F.struct(F.lit(0.0).alias("score"), null.alias("label"), null.alias("min_version"), null.alias("max_version"), none.alias("signals"))

    def take(acc: Column, x: Column) -> Column:
        score = F.when(F.size(x["signals"]) > 0, F.least(F.lit(G.MOST), x["base"] + (F.size(x["signals"]) - 1) * F.lit(G.STEP))).otherwise(F.lit(0.0))
        better = score > acc["score"]
        pick = lambda c: F.when(better, x[c]).otherwise(acc[c]).alias(c)
        return F.struct(F.when(better, score).otherwise(acc["score"]).alias("score"), pick("label"), pick("min_version"), pick("max_version"), F.when(better, F.concat(acc["signals"], x["signals"])).otherwise(acc["signals"]).alias("signals"))

    def finish(done: Column) -> Column:
        open_end = F.lit(f"{framework} (version undetermined from code)")
        return F.struct(
            done["min_version"].alias("min_version"), done["max_version"].alias("max_version"), F.coalesce(done["label"], open_end).alias("label"),
            F.when(done["label"].isNull(), F.lit(G.UNDETERMINED)).otherwise(done["score"]).alias("confidence"), done["signals"].alias("signals"),
        )

    return F.aggregate(rows, start, take, finish)


def inferences(content: Column) -> Column:
    """G2 for every registered framework: array of struct(framework, inference)."""
    every = lambda found: F.array(*[F.struct(F.lit(f).alias("framework"), _infer(f, found).alias("inference")) for f in G.FRAMEWORKS])
    return let(hits(content, [Pattern(*p) for b in G.BRACKETS for p in b[5]]), every)


def unknown_version(framework: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(null.alias("min_version"), null.alias("max_version"), F.concat(framework, F.lit(" (version unknown)")).alias("label"), F.lit(G.UNKNOWN).alias("confidence"), F.array().cast("array<string>").alias("signals"))


def api_matches(content: Column) -> Column:
    """G3 over all frameworks, in registry order."""
    rows = constant_rows(["framework", "api", "introduced", "deprecated", "description"], G.APIS)
    return F.transform(hits(content, [api_pattern(a[1]) for a in G.APIS]), lambda i: F.get(rows, i))


def match_apis(framework: Column, every: Column) -> Column:
    """A registered framework sees its own APIs, any other name (or null) all of them."""
    return F.when(framework.isin(G.FRAMEWORKS), F.filter(every, lambda a: a["framework"] == framework)).otherwise(every)


def deprecated_apis(every: Column) -> Column:
    """G4."""
    return F.filter(every, lambda a: a["deprecated"].isNotNull())


def distinct_by_url(sources: Column) -> Column:
    """The first source of each URL, in order."""
    return F.filter(sources, lambda s, i: F.array_position(F.transform(sources, lambda x: x["url"]), s["url"]) == i + 1)


def by_priority(sources: Column) -> Column:
    """Stable, ascending."""
    keyed = F.transform(sources, lambda s, i: F.struct(s["priority"].alias("p"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def _literal(rows: list[tuple]) -> Column:
    return constant_rows(["label", "url", "priority", "purpose"], [(label, url, p, purpose) for _, _, p, label, url, purpose in rows])


def grounding_sources(framework: Column, label: Column) -> Column:
    """The version's sources, then the framework's, first URL wins, by priority."""
    none, special, common = F.array().cast(SOURCE), None, None
    for f, name, *_ in G.BRACKETS:
        hit = (framework == f) & (label == name)
        value = _literal([s for s in G.SOURCES if s[:2] == (f, name)])
        special = F.when(hit, value) if special is None else special.when(hit, value)
    for f in G.FRAMEWORKS:
        value = _literal([s for s in G.SOURCES if s[:2] == (f, None)])
        common = F.when(framework == f, value) if common is None else common.when(framework == f, value)
    return by_priority(distinct_by_url(F.concat(special.otherwise(none), common.otherwise(none))))


def merge_sources(sets: Column) -> Column:
    """G6."""
    return by_priority(distinct_by_url(F.flatten(sets)))


def primary_sources(sources: Column) -> Column:
    """G7."""
    return F.filter(sources, lambda s: s["priority"] == 1)


def version_question(framework: Column, confidence: Column, label: Column) -> Column:
    """Null unless the version is in doubt and the framework has a question."""
    out = F.when(confidence >= Q.VERSION_BELOW, F.lit(None).cast("string"))
    for f, part, question in Q.VERSION_VARIANTS:
        out = out.when((framework == f) & label.contains(part), question)
    for f, question in Q.VERSION_QUESTIONS:
        before, mark, after = question.partition("{label}")
        out = out.when(framework == f, F.concat(F.lit(before), label, F.lit(after)) if mark else F.lit(question))
    return out


def ground(df: DataFrame, content: str = "content") -> DataFrame:
    """G9 and G10 over understand()'s columns: groundings and the roll-up columns, within the row."""
    text = F.coalesce(F.col(content), F.lit(""))
    df = df.withColumn("_names", frameworks_to_ground(F.col("framework.name"), F.col("dependencies")))

    def inferred(known: Column, name: Column) -> Column:
        own = F.get(F.filter(known, lambda x: x["framework"] == name), F.lit(0))["inference"]
        return F.struct(name.alias("framework"), F.coalesce(own, unknown_version(name)).alias("inference"))

    def one(apis: Column, x: Column) -> Column:
        name, inference = x["framework"], x["inference"]
        return F.struct(
            name.alias("framework"), inference.alias("inference"), match_apis(name, apis).alias("apis"),
            grounding_sources(name, inference["label"]).alias("sources"), version_question(name, inference["confidence"], inference["label"]).alias("question"),
        )

    # two passes, so that what follows from an inference reads it instead of repeating its expression
    versions = let(inferences(text), lambda known: F.transform("_names", lambda name: inferred(known, name)))
    df = df.withColumn("groundings", let(api_matches(text), lambda apis: F.transform(versions, lambda x: one(apis, x))))
    each = lambda f: F.transform("groundings", f)
    apis = F.flatten(each(lambda g: g["apis"]))
    keys = F.transform(apis, lambda a: F.concat(a["framework"], F.lit("::"), a["api"]))
    sources = merge_sources(each(lambda g: g["sources"]))
    asked = F.slice(F.array_distinct(F.filter(each(lambda g: g["question"]), lambda q: q.isNotNull())), 1, Q.VERSION_MOST)
    df = df.withColumns({
        "detected_apis": F.filter(apis, lambda a, i: F.array_position(keys, F.concat(a["framework"], F.lit("::"), a["api"])) == i + 1),
        "grounding_sources": sources,
        "version_questions": asked,
        "requires_version_clarification": (F.size(asked) > 0) | F.exists("groundings", lambda g: g["inference"]["confidence"] < Q.VERSION_BELOW),
    })
    count = F.size("grounding_sources")
    suffix = F.when(count > 0, F.concat(F.lit("— "), count.cast("string"), F.lit(" grounding source"), F.when(count != 1, "s").otherwise(""), F.lit(" ready"))).otherwise("— no grounding sources available")
    labels = F.array_join(F.transform(F.filter("groundings", lambda g: g["inference"]["confidence"] >= G.SUMMARY_LEAST), lambda g: g["inference"]["label"]), ", ")
    named = F.when(labels != "", F.concat(labels, F.lit(" "), suffix)).otherwise(F.concat(F.array_join("_names", ", "), F.lit(" (versions undetermined) "), suffix))
    return df.withColumn("grounding_summary", F.when(F.size("_names") == 0, G.NOTHING_TO_GROUND).otherwise(named)).drop("_names")


def registry_apis(spark: SparkSession) -> DataFrame:
    """All API patterns as rows."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(G.APIS, 1)], "ord int, framework string, api string, introduced string, deprecated string, description string")


#: Rules that a registry may hold: they become one expression.
MAX_RULES = 1000


def registry_rules(rules: DataFrame) -> list[tuple]:
    """A registry of (ord, framework, api, introduced, deprecated, description) rows, read, checked and in order: its extension is by rows.

    Raises ValueError for more than MAX_RULES rows, a null or empty framework or api, a repeated ord, or a repeated api of one framework.
    """
    rows = sorted(tuple(r) for r in rules.select("ord", "framework", "api", "introduced", "deprecated", "description").limit(MAX_RULES + 1).collect())
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if any(not r[1] or not r[2] or r[0] is None for r in rows) or len({r[0] for r in rows}) < len(rows) or len({r[1:3] for r in rows}) < len(rows):
        raise ValueError("rules need an ord of their own, a framework, and an api that is new to it")
    return rows


def registry_usage(artifacts: DataFrame, rules: DataFrame) -> DataFrame:
    """G11 and J3 as data: every rule of the registry with the number of artifacts whose content uses it, zeros included.

    The patterns are made from the rows when the query is built and each is
    evaluated once a text; what moves is a count for each rule and task.
    """
    rows = registry_rules(rules)
    table = artifacts.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "number int, ord int, framework string, api string, introduced string, deprecated string, description string")
    if not rows:
        return table.drop("number").withColumn("n_artifacts", F.lit(0).cast("long"))
    used = artifacts.select(F.explode(hits(F.col("content"), [api_pattern(r[2]) for r in rows])).alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("n"))
    return table.join(used, "number", "left").select(*table.columns[1:], F.coalesce("n", F.lit(0)).cast("long").alias("n_artifacts"))
