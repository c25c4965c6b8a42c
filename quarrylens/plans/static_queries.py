"""Queries of the static scan: sinks near input, entries, function scores, context and requests. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens import dims
from quarrylens.functions import text as T
from quarrylens.operators import static
from quarrylens.plans import code_queries
from quarrylens.plans.code_queries import LINES, _in, _q
from quarrylens.session import table

QUERIES, ORACLE = {}, {}
CODE, ORACLE_SCORE = code_queries.QUERIES, code_queries.ORACLE["signal_score"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


PY = "lower(file) LIKE '%.py'"
JS = "regexp_matches(lower(file), '\\.(js|ts|jsx|tsx|mjs|cjs)$')"
_LS = LINES.format(c="code")


def _first_sql(patterns: list[str], c: str) -> str:
    """The first pattern's match in a text."""
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, '{_q(p)}', 0), '')" for p in patterns) + ")"


def _around_sql(n: int) -> str:
    return f"array_to_string(ls[greatest(1, i - {n}) : i + {n}], chr(10))"


def _python(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").where("lower(file) like '%.py' and code <> ''")


def _script(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").where(T.is_script("file") & (F.col("code") != ""))


_PY_DIM = ", ".join(
    f"('{kind}', '{s}', {i}, '{s.rpartition('.')[2]}', '{s.rpartition('.')[0]}', '{s.rpartition('.')[0].rpartition('.')[2]}')"
    for kind, names in dims.PY_SINKS.items() for i, s in enumerate(names)
)


@query(f"""
    WITH dim AS (SELECT * FROM (VALUES {_PY_DIM}) t(vuln_type, sink, pos, method, obj, tail)),
    r AS (SELECT id, code, {_LS} AS ls FROM nodes WHERE {PY} AND code <> ''),
    l AS (SELECT id, code, ls, unnest(range(1, len(ls) + 1)) AS i FROM r),
    c AS (SELECT DISTINCT id, code, ls, i, unnest(regexp_extract_all(ls[i], '([A-Za-z_][A-Za-z0-9_.]*) *\\(', 1)) AS called FROM l),
    h AS (SELECT id, code, ls, i, called, vuln_type, min(pos) AS pos FROM c JOIN dim ON dim.method = regexp_extract(called, '([^.]*)$', 1)
          AND (dim.obj = '' OR contains(called, '.') AND (regexp_extract(called, '^(.*)\\.', 1) = dim.obj OR ends_with(regexp_extract(called, '^(.*)\\.', 1), dim.tail))) GROUP BY ALL),
    s AS (SELECT id, vuln_type, sink, i, coalesce({_first_sql(dims.PY_INPUT, _around_sql(5))}, {_first_sql(dims.PY_INPUT, 'code')}) AS source_hint FROM h JOIN dim USING (vuln_type, pos))
    SELECT DISTINCT id, vuln_type, sink AS sink_name, i::INT AS sink_line, source_hint FROM s WHERE source_hint IS NOT NULL""")
def python_sinks(spark: SparkSession, d: str) -> DataFrame:
    """Calls of Python sinks with a hint of input within five lines, else anywhere in the function."""
    rows = _python(spark, d).where(T.any_match("code", dims.PY_INPUT))
    calls = static.line_calls(rows, "id", "code")
    found = static.match_sinks(calls, dims.PY_SINKS)
    hint = F.coalesce(T.first_match(static.around("ls", "line", 5), dims.PY_INPUT), T.first_match(F.col("code"), dims.PY_INPUT))
    return found.select("id", "vuln_type", "sink_name", F.col("line").alias("sink_line"), hint.alias("source_hint")).where("source_hint is not null").distinct()


_JS_MATCHES = " UNION ALL ".join(
    f"SELECT id, ls, i, '{kind}' AS vuln_type, unnest(regexp_extract_all(ls[i], '{_q(p)}', 0)) AS m FROM l" for kind, ps in dims.JS_SINKS.items() for p in ps
)


@query(f"""
    WITH r AS (SELECT id, {_LS} AS ls FROM nodes WHERE {JS} AND code <> ''),
    l AS (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS i FROM r),
    h AS (SELECT DISTINCT id, vuln_type, i, substr(m, 1, 60) AS sink_name, coalesce({_first_sql(dims.JS_INPUT, _around_sql(5))}, {_first_sql(dims.JS_INPUT, _around_sql(30))}) AS hint FROM ({_JS_MATCHES}))
    SELECT DISTINCT id, vuln_type, sink_name, i::INT AS sink_line,
      CASE WHEN vuln_type = 'HARDCODED_SECRET' THEN 'hardcoded value' ELSE coalesce(hint, 'indirect') END AS source_hint,
      CASE WHEN vuln_type = 'HARDCODED_SECRET' THEN 0.8::DOUBLE ELSE 0.65::DOUBLE END AS confidence
    FROM h WHERE hint IS NOT NULL OR vuln_type IN ('HARDCODED_SECRET', 'AFO', 'SSRF')""")
def script_sinks(spark: SparkSession, d: str) -> DataFrame:
    """Sinks of scripts by kind; secrets always, written files and requests also without input nearby, others with input within 5, else 30 lines."""
    found = static.pattern_hits(_script(spark, d), "id", "code", dims.JS_SINKS)
    hint = F.coalesce(T.first_match(static.around("ls", "line", 5), dims.JS_INPUT), T.first_match(static.around("ls", "line", 30), dims.JS_INPUT))
    secret = F.col("vuln_type") == "HARDCODED_SECRET"
    return found.select("id", "vuln_type", F.substring("match", 1, 60).alias("sink_name"), F.col("line").alias("sink_line"), hint.alias("hint")).where(
        F.col("hint").isNotNull() | F.col("vuln_type").isin("HARDCODED_SECRET", "AFO", "SSRF")
    ).select(
        "id", "vuln_type", "sink_name", "sink_line", F.when(secret, "hardcoded value").otherwise(F.coalesce("hint", F.lit("indirect"))).alias("source_hint"),
        F.when(secret, 0.8).otherwise(0.65).alias("confidence"),
    ).distinct()


@query(f"""
    WITH r AS (SELECT id, {_LS} AS ls FROM nodes WHERE {PY} AND code <> ''),
    l AS (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS i FROM r),
    h AS (SELECT id, ls, i FROM l WHERE {' OR '.join(f"regexp_matches(ls[i], '{_q(p)}')" for p in dims.REDOS)})
    SELECT id, i::INT AS line, {_first_sql(dims.PY_INPUT, _around_sql(10))} AS near_input FROM h WHERE {_first_sql(dims.PY_INPUT, _around_sql(10))} IS NOT NULL""")
def nested_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a pattern of nested repetition and input within ten lines."""
    found = static.pattern_hits(_python(spark, d), "id", "code", {"REDOS": dims.REDOS}).select("id", "line", "ls").distinct()
    return found.select("id", "line", T.first_match(static.around("ls", "line", 10), dims.PY_INPUT).alias("near_input")).where("near_input is not null")


_DECORATORS = "list_transform(regexp_extract_all(code, '(?m)^[ \\t]*@(?:[A-Za-z_][A-Za-z0-9_]*\\.)*([A-Za-z_][A-Za-z0-9_]*)', 1), lambda x: lower(x))"
_PARAMETERS = "list_transform(string_split(regexp_extract(code, 'def +[A-Za-z_][A-Za-z0-9_]* *\\(([^)]*)\\)', 1), ','), lambda x: regexp_extract(trim(x), '^([A-Za-z_][A-Za-z0-9_]*)', 1))"


@query(f"""
    SELECT id, len(list_intersect({_DECORATORS}, [{_in(dims.ENTRY_DECORATORS)}])) > 0 AS by_decorator,
      {' OR '.join(f"starts_with(name, '{p}')" for p in dims.ENTRY_PREFIXES)} AS by_name,
      NOT starts_with(name, '_') AND len(list_intersect({_PARAMETERS}, [{_in(dims.ENTRY_PARAMETERS)}])) > 0 AS by_parameter
    FROM nodes WHERE {PY} AND code <> '' AND name IS NOT NULL""")
def tag_entries(spark: SparkSession, d: str) -> DataFrame:
    """Whether a function is an entry: by decorator, by the beginning of its name, by a public name with a parameter for input."""
    rows = _python(spark, d).where("name is not null")
    return rows.select(
        "id", F.arrays_overlap(static.decorators("code"), static.literals(dims.ENTRY_DECORATORS)).alias("by_decorator"),
        T.any_prefix("name", dims.ENTRY_PREFIXES).alias("by_name"),
        (~F.col("name").startswith("_") & F.arrays_overlap(static.parameters("code"), static.literals(dims.ENTRY_PARAMETERS))).alias("by_parameter"),
    )


_OPEN, _SHUT = "(length({x}) - length(replace({x}, '{{', '')))", "(length({x}) - length(replace({x}, '}}', '')))"
_BLOCKS = f"""
    l AS (SELECT id, i, ls, {_OPEN.format(x='ls[i]')} AS o, {_SHUT.format(x='ls[i]')} AS s FROM (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS i FROM r)),
    c AS (SELECT *, sum(o) OVER w AS co, sum(o - s) OVER w AS cd FROM l WINDOW w AS (PARTITION BY id ORDER BY i)),
    b AS (SELECT f.id, f.i, any_value(f.ls) AS ls, coalesce(min(CASE WHEN g.co - f.co + f.o > 0 AND g.cd - f.cd + f.o - f.s <= 0 THEN g.i END), max(g.i)) AS last,
          bool_or(g.co - f.co + f.o > 0 AND g.cd - f.cd + f.o - f.s <= 0) AS closed
          FROM c f JOIN c g ON g.id = f.id AND g.i BETWEEN f.i AND f.i + 59 WHERE {{start}} GROUP BY 1, 2)"""


@query(f"""
    WITH r AS (SELECT id, {_LS} AS ls FROM nodes WHERE {JS} AND code <> ''), {_BLOCKS.replace('{start}', f"regexp_matches(f.ls[f.i], '{_q(dims.JS_FUNCTION)}')")},
    n AS (SELECT id, i, last, array_to_string(ls[i : last], chr(10)) AS block, coalesce(nullif(regexp_extract(ls[i], '{_q(dims.JS_FUNCTION)}', 1), ''), nullif(regexp_extract(ls[i], '{_q(dims.JS_FUNCTION)}', 2), ''),
          nullif(regexp_extract(ls[i], '{_q(dims.JS_FUNCTION)}', 3), ''), 'anon') AS name FROM b),
    g AS (SELECT id, i, last, name, block, list_filter([CASE WHEN regexp_matches(name, '{_q(dims.JS_INTENT)}') THEN 'name:' || name END,
          {', '.join(f"CASE WHEN regexp_matches(block, '{_q(p)}') THEN 'sink:{k}' END" for k, p in dims.JS_BODY_SINKS.items())}], lambda x: x IS NOT NULL) AS signals FROM n),
    t AS (SELECT *, (CASE WHEN regexp_matches(name, '{_q(dims.JS_INTENT)}') THEN 2.0 ELSE 0.0 END + 2.5 * len(list_filter(signals, lambda x: starts_with(x, 'sink:'))) +
          CASE WHEN regexp_matches(block, '{_q(dims.JS_INTENT)}') THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM g)
    SELECT id, name, i::INT AS start_line, last::INT AS end_line, array_to_string(signals[1 : 4], ',') AS signals, score,
      CASE WHEN score >= 8 THEN 'high' WHEN score >= 5 THEN 'medium' ELSE 'low' END AS tier, least(score / 10, 0.95)::DOUBLE AS confidence
    FROM t WHERE len(signals) > 0 AND score >= 2""")
def script_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions of scripts scored by their name, the sinks in their block and its words; with tier and confidence."""
    f = static.brace_functions(_script(spark, d), "id", "code", dims.JS_FUNCTION)
    intent = lambda c: F.col(c).rlike(dims.JS_INTENT)
    signals = F.array_compact(F.array(
        F.when(intent("name"), F.concat(F.lit("name:"), "name")), *(F.when(F.col("block").rlike(p), F.lit(f"sink:{k}")) for k, p in dims.JS_BODY_SINKS.items())
    ))
    sinks = F.size(F.filter("signals", lambda x: x.startswith("sink:")))
    score = F.when(intent("name"), 2.0).otherwise(0.0) + sinks * 2.5 + F.when(intent("block"), 1.0).otherwise(0.0)
    return f.withColumn("signals", signals).withColumn("score", score).where("size(signals) > 0 and score >= 2").select(
        "id", "name", "start_line", "end_line", F.array_join(F.slice("signals", 1, 4), ",").alias("signals"), "score",
        F.when(F.col("score") >= 8, "high").when(F.col("score") >= 5, "medium").otherwise("low").alias("tier"), F.least(F.col("score") / 10, F.lit(0.95)).alias("confidence"),
    )


@query(f"""
    WITH r AS (SELECT id, {_LS} AS ls FROM nodes WHERE contains(code, '{{')), {_BLOCKS.replace('{start}', 'f.i = 1')}
    SELECT id, last::INT AS block_lines, closed FROM b""")
def brace_blocks(spark: SparkSession, d: str) -> DataFrame:
    """From the first line to where its braces are closed again, at most sixty lines."""
    from quarrylens.operators import chunks

    return chunks.brace_blocks(table(spark, d, "nodes"), "id", "code")


def _matches_sql(patterns: list[str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"nullif(substr(regexp_extract(code, '{_q(p)}', 0), 1, 40), '')" for p in patterns) + "], lambda x: x IS NOT NULL), '|')"


@query(f"""
    SELECT chunk_id, {_matches_sql(dims.CHUNK_SOURCES)} AS sources, {_matches_sql(dims.CHUNK_DANGERS)} AS dangers
    FROM code_chunks WHERE code <> '' AND ({_matches_sql(dims.CHUNK_SOURCES)} <> '' OR {_matches_sql(dims.CHUNK_DANGERS)} <> '')""")
def signal_matches(spark: SparkSession, d: str) -> DataFrame:
    """The text (at most forty characters) that each source and danger pattern meets first, of chunks that have any."""
    both = table(spark, d, "code_chunks").where("code <> ''").select(
        "chunk_id", T.matched_texts("code", dims.CHUNK_SOURCES).alias("sources"), T.matched_texts("code", dims.CHUNK_DANGERS).alias("dangers")
    )
    return both.where("sources <> '' or dangers <> ''")


@query(f"""
    SELECT chunk_id FROM code_chunks WHERE regexp_matches(code, '{_q("request|req[.]|argv|stdin")}') AND regexp_matches(code, '{_q("eval|exec|pickle|subprocess|os[.]system")}')""")
def priority_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with a source like HTTP or the command line and a critical danger."""
    return table(spark, d, "code_chunks").where(F.col("code").rlike("request|req[.]|argv|stdin") & F.col("code").rlike("eval|exec|pickle|subprocess|os[.]system")).select("chunk_id")


SURFACE = {"request": "request\\.|req\\.", "argv": "argv", "environ": "environ|process\\.env|Getenv", "stdin": "\\binput\\(|stdin"}
SURFACE_SINKS = {"shell": "shell *= *True", "write_mode": "open\\([^)]*['\"][wax]b?['\"]", "system": "\\bsystem\\(|popen\\(", "sql": "\\.execute\\(|\\.query\\(|\\.Query\\("}


@query(f"""
    SELECT repo, file, {', '.join(f"count_if(regexp_matches(code, '{_q(p)}')) AS {k}_sources" for k, p in SURFACE.items())}, {', '.join(f"count_if(regexp_matches(code, '{_q(p)}')) AS {k}_sinks" for k, p in SURFACE_SINKS.items())}
    FROM nodes WHERE code <> '' AND file IS NOT NULL GROUP BY 1, 2""")
def attack_surface(spark: SparkSession, d: str) -> DataFrame:
    """Functions with sources and sinks of each kind, per file."""
    count = lambda kinds, suffix: [F.count_if(F.col("code").rlike(p)).alias(f"{k}_{suffix}") for k, p in kinds.items()]
    return table(spark, d, "nodes").where("code <> '' and file is not null").groupBy("repo", "file").agg(*count(SURFACE, "sources"), *count(SURFACE_SINKS, "sinks"))


# --- files, imports, context ----------------------------------------------------------------------------------------

SKIP = {
    "intent": ["tests", "test", ".git", "__pycache__", "node_modules", "venv", ".venv", "docs", "cookbook", "migrations", "enterprise", ".github", "ui", "static", "examples"],
    "graph": ["tests", "test", ".git", "__pycache__", "node_modules", "venv", ".venv", "docs", "cookbook", "migrations", "enterprise", ".github", "ui", "static"],
    "chunks": [".git", "__pycache__", "node_modules", "dist", "build", "test", "tests", "spec", ".venv", "venv", "vendor", "migrations", "fuzz", "scripts", "docs", "examples", "benchmark", "benchmarks"],
    "scripts": ["node_modules", ".git", "dist", "build", "__pycache__", "venv", ".venv", "coverage", "logs", "migrations"],
}


def _outside_sql(names: list[str]) -> str:
    return f"len(list_filter(string_split(file, '/'), lambda x: x IN ({_in(names)}))) = 0"


@query(" UNION ALL ".join(
    f"SELECT '{walk}' AS walk, repo, count(DISTINCT file) AS files FROM nodes WHERE {JS if walk == 'scripts' else PY} AND {_outside_sql(names)} GROUP BY 2" for walk, names in SKIP.items()
))
def walks(spark: SparkSession, d: str) -> DataFrame:
    """Files that each kind of walk (graph, intent, chunks, scripts) visits, by its own skipped directories."""
    nodes = table(spark, d, "nodes").where("file is not null")
    parts = [
        nodes.where((T.is_script("file") if walk == "scripts" else F.lower("file").endswith(".py")) & ~F.arrays_overlap(F.split("file", "/"), static.literals(names)))
        .groupBy("repo").agg(F.countDistinct("file").alias("files")).select(F.lit(walk).alias("walk"), "repo", "files")
        for walk, names in SKIP.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_IMPORTED = f"""
    i AS (SELECT DISTINCT repo, file, m AS module FROM (
      SELECT repo, file, unnest(list_concat(regexp_extract_all(code, '(?m)^[ \\t]*from[ \\t]+([A-Za-z0-9_.]+)[ \\t]+import', 1), regexp_extract_all(code, '(?m)^[ \\t]*import[ \\t]+([A-Za-z0-9_.]+)', 1))) AS m FROM nodes WHERE {PY} AND code <> ''
      UNION ALL SELECT repo, file, unnest(regexp_extract_all(code, '(?:import|require)[ \\t]*[ (][''"]([./][^''"]+)[''"]', 1)) FROM nodes WHERE {JS} AND code <> '') WHERE m <> '')"""


@query(f"WITH {_IMPORTED} SELECT repo, file, count(*) AS modules, array_to_string(list_sort(list(module))[1 : 12], ', ') AS first_modules FROM i GROUP BY 1, 2")
def file_imports(spark: SparkSession, d: str) -> DataFrame:
    """Modules a file imports: their number and the first twelve in order."""
    return static.imports(table(spark, d, "nodes")).groupBy("repo", "file").agg(
        F.count(F.lit(1)).alias("modules"), F.array_join(F.slice(F.array_sort(F.collect_list("module")), 1, 12), ", ").alias("first_modules")
    )


_STEM = "regexp_extract({c}, '([^/]*?)(?:\\.[A-Za-z]+)?$', 1)"
_RANK = "CASE WHEN " + " OR ".join(f"contains(lower({_STEM.format(c='n.file')}), '{k}')" for k in dims.CALLER_PRIORITY) + " THEN 0 ELSE 1 END"


@query(f"""
    WITH f AS (SELECT DISTINCT repo, file, {_STEM.format(c='file')} AS stem FROM nodes WHERE file IS NOT NULL AND repo IS NOT NULL),
    w AS (SELECT DISTINCT repo, file, unnest(regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]*)', 1)) AS word FROM nodes WHERE code <> '' AND regexp_matches(code, 'import|require')),
    n AS (SELECT f.repo, f.file AS target, w.file AS file FROM f JOIN w ON w.repo = f.repo AND w.word = f.stem AND w.file <> f.file),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo, target ORDER BY {_RANK}, file) AS rank FROM n)
    SELECT repo, target, file AS caller, rank::INT AS rank FROM r WHERE rank <= 5""")
def import_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Up to five files of a repository that import and name another file, routers and views first: an equi-join on the words of their code."""
    return static.neighbours(table(spark, d, "nodes"), dims.CALLER_PRIORITY, 5)


@query(f"""
    WITH o AS (SELECT v.vuln_id, v.affected_line, n.file, n.start_line, n.code, row_number() OVER (PARTITION BY v.vuln_id ORDER BY n.start_line DESC, n.id) AS r
      FROM vulns v JOIN registry g ON g.id = v.candidate_id JOIN nodes n ON n.repo = g.package AND n.file = replace(v.affected_file, chr(92), '/') AND v.affected_line BETWEEN n.start_line AND n.end_line),
    s AS (SELECT vuln_id, file, affected_line, (affected_line - start_line + 1) AS i, {LINES.format(c='code')} AS ls FROM o WHERE r = 1 AND code <> '')
    SELECT vuln_id, '# FILE: ' || file || '  <- SINK AT LINE ' || affected_line || chr(10) || array_to_string(ls[greatest(1, i - 150) : i + 150], chr(10)) AS section FROM s""")
def relevant_sections(spark: SparkSession, d: str) -> DataFrame:
    """The owner's code within 150 lines of a finding, under a header that names file and line."""
    from quarrylens.plans.graph_queries import line_owner_inner

    v = table(spark, d, "vulns").select("vuln_id", "affected_line")
    n = table(spark, d, "nodes").where("code <> ''").select(F.col("id").alias("node_id"), "file", "start_line", T.lines("code").alias("ls"))
    at = F.col("affected_line") - F.col("start_line") + 1
    header = F.concat(F.lit("# FILE: "), "file", F.lit("  <- SINK AT LINE "), F.col("affected_line").cast("string"), F.lit("\n"))
    return line_owner_inner(spark, d).join(v, "vuln_id").join(n, "node_id").withColumn("line", at).select(
        "vuln_id", F.concat(header, static.around("ls", "line", 150)).alias("section")
    )


# --- requests to a scorer and their results -------------------------------------------------------------------------

_PROMPT = "concat_ws(chr(10), '## ' || coalesce(vuln_type, 'unknown'), substr(coalesce(description, ''), 1, 600), substr(coalesce(poc_code, ''), 1, 3000))"


@query(f"""
    SELECT printf('req-%06d', vuln_id) AS request_id, vuln_id, (vuln_id // 6)::BIGINT AS batch, {_PROMPT} AS prompt FROM vulns WHERE coalesce(description, '') <> '' OR coalesce(poc_code, '') <> ''""")
def scorer_requests(spark: SparkSession, d: str) -> DataFrame:
    """Keyed requests in small batches with capped parts; batches follow the id, so no rank over all rows is needed."""
    v = table(spark, d, "vulns").where("coalesce(description, '') <> '' or coalesce(poc_code, '') <> ''")
    return v.select(F.format_string("req-%06d", "vuln_id").alias("request_id"), "vuln_id", F.floor(F.col("vuln_id") / 6).alias("batch"), static.prompt().alias("prompt"))


_LATEST = "SELECT vuln_id, max((coalesce(reviewed_at, TIMESTAMP '1970-01-01'), da_id)) AS k FROM da_results WHERE vuln_id IS NOT NULL GROUP BY 1"


@query(f"""
    WITH k AS ({_LATEST}), a AS (SELECT r.vuln_id, r.da_survived, r.final_confidence, r.rebuttal FROM da_results r JOIN k ON k.vuln_id = r.vuln_id AND k.k[2] = r.da_id),
    j AS (SELECT v.vuln_id, CASE WHEN a.vuln_id IS NULL THEN 'unanswered' WHEN a.da_survived IS NULL THEN 'unparsed' WHEN a.da_survived THEN 'survived' ELSE 'rejected' END AS verdict,
      coalesce(a.final_confidence, v.confidence, 0.5) AS confidence, coalesce(trim(a.rebuttal), '') <> '' AS reasoned FROM vulns v LEFT JOIN a USING (vuln_id))
    SELECT vuln_id, verdict, confidence, verdict IN ('survived', 'unparsed', 'unanswered') AND confidence >= 0.5 AND (reasoned OR verdict <> 'survived') AS passes FROM j""")
def scorer_results(spark: SparkSession, d: str) -> DataFrame:
    """Requests with their latest answer: missing and unreadable answers pass on by policy, a survivor needs a reason, all need confidence."""
    from quarrylens.operators import funnel

    da = table(spark, d, "da_results").select("vuln_id", F.coalesce("reviewed_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"), "da_id", "da_survived", "final_confidence", "rebuttal")
    answers = funnel.latest(da, "vuln_id", ["at", "da_id"]).withColumn("answered", F.lit(True))
    j = table(spark, d, "vulns").select("vuln_id", F.col("confidence").alias("own")).join(answers, "vuln_id", "left")
    verdict = F.when(F.col("answered").isNull(), "unanswered").when(F.col("da_survived").isNull(), "unparsed").when(F.col("da_survived"), "survived").otherwise("rejected")
    j = j.select("vuln_id", verdict.alias("verdict"), F.coalesce("final_confidence", "own", F.lit(0.5)).alias("confidence"), (F.coalesce(F.trim("rebuttal"), F.lit("")) != "").alias("reasoned"))
    passes = F.col("verdict").isin("survived", "unparsed", "unanswered") & (F.col("confidence") >= 0.5) & (F.col("reasoned") | (F.col("verdict") != "survived"))
    return j.select("vuln_id", "verdict", "confidence", passes.alias("passes"))


@query("""
    WITH p AS (SELECT vuln_id, max((coalesce(final_confidence, 0.0), da_id)) AS k FROM da_results WHERE vuln_id IS NOT NULL GROUP BY 1)
    SELECT v.vuln_id, to_json({'vuln_class': coalesce(nullif(v.vuln_type, ''), 'unknown'), 'verdict': CASE WHEN r.da_survived THEN 'confirmed' WHEN r.da_survived IS NULL THEN 'likely' ELSE 'rejected' END,
      'reason': coalesce(nullif(r.rebuttal, ''), nullif(v.root_cause, ''), nullif(v.description, ''), ''), 'file': coalesce(v.affected_file, '')})::VARCHAR AS gate
    FROM vulns v JOIN p USING (vuln_id) JOIN da_results r ON r.da_id = p.k[2]""")
def gate_structs(spark: SparkSession, d: str) -> DataFrame:
    """The strongest review of a finding as the nested input of the next gate, with fallbacks for missing parts."""
    from quarrylens.operators import funnel

    da = table(spark, d, "da_results").select("vuln_id", F.coalesce("final_confidence", F.lit(0.0)).alias("c"), "da_id", "da_survived", "rebuttal")
    j = table(spark, d, "vulns").join(funnel.latest(da, "vuln_id", ["c", "da_id"]), "vuln_id")
    some = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(""))
    return j.select("vuln_id", F.to_json(F.struct(
        F.coalesce(F.nullif(F.col("vuln_type"), F.lit("")), F.lit("unknown")).alias("vuln_class"),
        F.when(F.col("da_survived"), "confirmed").when(F.col("da_survived").isNull(), "likely").otherwise("rejected").alias("verdict"),
        some("rebuttal", "root_cause", "description").alias("reason"), F.coalesce("affected_file", F.lit("")).alias("file"),
    )).alias("gate"))


@query("""
    WITH t AS (SELECT 'rebuttal' AS origin, da_id AS row_id, rebuttal AS text FROM da_results UNION ALL SELECT 'stdout', run_id, stdout FROM poc_results UNION ALL SELECT 'props', event_id, '[' || props || ']' FROM events),
    c AS (SELECT origin, row_id, [trim(text), regexp_extract(text, '(?s)```(?:json)?\\s*(\\[.*?\\])\\s*```', 1), regexp_extract(text, '(?s)(\\[.*\\])', 1)] AS tries FROM t WHERE text IS NOT NULL),
    g AS (SELECT origin, row_id, list_filter(tries, lambda x: starts_with(x, '[') AND json_valid(x))[1] AS found FROM c)
    SELECT origin, row_id, json_array_length(found)::INT AS items FROM g WHERE found IS NOT NULL""")
def json_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists in JSON inside texts: the whole text, else a fenced list, else from the first to the last bracket."""
    t = table(spark, d, "da_results").select(F.lit("rebuttal").alias("origin"), F.col("da_id").alias("row_id"), F.col("rebuttal").alias("text"))
    t = t.unionByName(table(spark, d, "poc_results").select(F.lit("stdout").alias("origin"), F.col("run_id").alias("row_id"), F.col("stdout").alias("text")))
    t = t.unionByName(table(spark, d, "events").select(F.lit("props").alias("origin"), F.col("event_id").alias("row_id"), F.concat(F.lit("["), "props", F.lit("]")).alias("text")))
    return t.where("text is not null").select("origin", "row_id", T.json_list_items("text").alias("items")).where("items is not null")


@query("SELECT vuln_id, try_cast(nullif(regexp_extract(vuln_type, '(?i)CWE[-_ ]?([0-9]+)', 1), '') AS INT) AS cwe, coalesce(nullif(regexp_extract(lower(trim(vuln_type)), '^([^ :]+)', 1), ''), 'other') AS rule FROM vulns")
def class_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The number of a weakness class without leading zeros, null where none is named, and the first word as a rule."""
    return table(spark, d, "vulns").select(
        "vuln_id", F.expr("try_cast(nullif(regexp_extract(vuln_type, '(?i)CWE[-_ ]?([0-9]+)', 1), '') as int)").alias("cwe"),
        F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim("vuln_type")), "^([^ :]+)", 1), F.lit("")), F.lit("other")).alias("rule"),
    )


@query("""
    SELECT vuln_id, CASE WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS tier, CASE lower(split_part(coalesce(cvss_vector, ''), '/', 1)) WHEN 'critical' THEN 'Critical' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'low' THEN 'Low' ELSE 'Informational' END AS severity_text,
      md5(coalesce(candidate_id, '') || '|' || vuln_id) AS key FROM vulns WHERE confidence IS NOT NULL""")
def verdict_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tier by confidence, severity text to its known names (others are informational), and a key that is alike in every run."""
    text = F.initcap(F.lower(F.split(F.coalesce("cvss_vector", F.lit("")), "/")[0]))
    return table(spark, d, "vulns").where("confidence is not null").select(
        "vuln_id", F.when(F.col("confidence") >= 0.7, "medium").otherwise("low").alias("tier"),
        F.when(text.isin("Critical", "High", "Medium", "Low"), text).otherwise("Informational").alias("severity_text"),
        F.md5(F.concat_ws("|", F.coalesce("candidate_id", F.lit("")), F.col("vuln_id").cast("string"))).alias("key"),
    )


@query("SELECT lower(package) AS package, count(*) AS entries, min(id) AS first_id, count_if(github_url IS NULL) AS without_url, coalesce(max(nullif(lower(trim(ecosystem)), '')), 'unknown') AS ecosystem FROM registry GROUP BY 1")
def registry_index(spark: SparkSession, d: str) -> DataFrame:
    """The registry by package without regard to case: entries, the first id, missing addresses."""
    return table(spark, d, "registry").groupBy(F.lower("package").alias("package")).agg(
        F.count(F.lit(1)).alias("entries"), F.min("id").alias("first_id"), F.count_if(F.col("github_url").isNull()).alias("without_url"),
        F.coalesce(F.max(F.nullif(F.lower(F.trim("ecosystem")), F.lit(""))), F.lit("unknown")).alias("ecosystem"),
    )


@query("""
    SELECT repo, count(*) AS nodes, count_if(coalesce(is_entry, false)) AS entries, count_if(coalesce(is_sink, false)) AS sinks, count_if(coalesce(is_gate, false)) AS gates, count_if(coalesce(code, '') = '') AS unreadable,
      sum(coalesce(c.edges, 0))::BIGINT AS edges FROM nodes LEFT JOIN (SELECT caller_id, count(DISTINCT callee_name) AS edges FROM edges WHERE callee_name <> '' GROUP BY 1) c ON c.caller_id = nodes.id GROUP BY 1""")
def graph_store(spark: SparkSession, d: str) -> DataFrame:
    """What a stored graph holds per repository: nodes by tag, distinct calls, rows without readable code."""
    calls = table(spark, d, "edges").where("callee_name <> ''").select("caller_id", "callee_name").distinct().groupBy("caller_id").agg(F.count(F.lit(1)).alias("edges"))
    tag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    n = table(spark, d, "nodes").join(calls.withColumnRenamed("caller_id", "id"), "id", "left")
    return n.groupBy("repo").agg(
        F.count(F.lit(1)).alias("nodes"), tag("is_entry").alias("entries"), tag("is_sink").alias("sinks"), tag("is_gate").alias("gates"),
        F.count_if(F.coalesce("code", F.lit("")) == "").alias("unreadable"), F.sum(F.coalesce("edges", F.lit(0))).alias("edges"),
    )


@query("""
    WITH b AS (SELECT repo, file, name, min((coalesce(start_line, 0), id)) AS k, count(*) AS copies FROM nodes WHERE name <> '' AND code <> '' GROUP BY 1, 2, 3)
    SELECT b.repo, b.file, b.name, b.copies, n.id, n.code AS body FROM b JOIN nodes n ON n.id = b.k[2]""")
def function_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The body of each function name of a file: the first of several."""
    n = table(spark, d, "nodes").where("name <> '' and code <> ''")
    first = F.min(F.struct(F.coalesce("start_line", F.lit(0)).alias("at"), F.col("id"), F.col("code"))).alias("b")
    return n.groupBy("repo", "file", "name").agg(first, F.count(F.lit(1)).alias("copies")).select("repo", "file", "name", "copies", "b.id", F.col("b.code").alias("body"))


@query("SELECT caller_id, count(*) AS calls, array_to_string(list(callee_name ORDER BY callee_name), ',') AS names FROM (SELECT DISTINCT caller_id, callee_name FROM edges WHERE callee_name <> '') GROUP BY 1")
def call_lists(spark: SparkSession, d: str) -> DataFrame:
    """Distinct called names of a function in order."""
    e = table(spark, d, "edges").where("callee_name <> ''").select("caller_id", "callee_name").distinct()
    return e.groupBy("caller_id").agg(F.count(F.lit(1)).alias("calls"), F.array_join(F.array_sort(F.collect_list("callee_name")), ",").alias("names"))


@query("""
    SELECT lower(trim(source)) AS source, count(*) AS runs, count_if(coalesce(vulnerable, false)) AS confirmed, count_if(coalesce(executed, false) AND NOT coalesce(vulnerable, false)) AS likely,
      count_if(NOT coalesce(executed, false)) AS not_run, round(count_if(coalesce(vulnerable, false)) / count(*), 6) AS rate FROM poc_results GROUP BY 1""")
def confirmed_split(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each source that confirm, that ran without, and that did not run."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return table(spark, d, "poc_results").groupBy(F.lower(F.trim("source")).alias("source")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(yes("vulnerable")).alias("confirmed"), F.count_if(yes("executed") & ~yes("vulnerable")).alias("likely"),
        F.count_if(~yes("executed")).alias("not_run"), F.round(F.count_if(yes("vulnerable")) / F.count(F.lit(1)), 6).alias("rate"),
    )


@query("""
    WITH r AS (SELECT lower(trim(source)) AS source, vuln_id // 1000 AS block, coalesce(nullif(regexp_extract(lower(trim(vuln_type)), '^([^ :]+)', 1), ''), 'other') AS rule, vuln_id FROM vulns)
    SELECT source, block, count(*) AS results, count(DISTINCT rule) AS rules, array_to_string(list(DISTINCT rule ORDER BY rule), ',') AS rule_ids, min(vuln_id) AS first_result, max(vuln_id) AS last_result FROM r GROUP BY 1, 2""")
def result_documents(spark: SparkSession, d: str) -> DataFrame:
    """What the report documents hold: one for each source and thousand ids, with distinct rules and all results."""
    from quarrylens.operators import emit

    docs = emit.documents(table(spark, d, "vulns"))
    run = F.from_json("document", "runs array<struct<tool struct<driver struct<rules array<struct<id string>>>>, results array<struct<ruleId string, properties struct<vuln_id long>>>>>")["runs"][0]
    rules, ids = F.transform(run["tool"]["driver"]["rules"], lambda r: r["id"]), F.transform(run["results"], lambda r: r["properties"]["vuln_id"])
    return docs.select(
        "source", "block", F.size(run["results"]).cast("long").alias("results"), F.size(rules).cast("long").alias("rules"), F.array_join(rules, ",").alias("rule_ids"),
        F.array_min(ids).alias("first_result"), F.array_max(ids).alias("last_result"),
    )


# --- narrowing --------------------------------------------------------------------------------------------------------

_TIERS = "CASE WHEN score >= 6 THEN 'medium' WHEN score >= 4 THEN 'low' ELSE 'none' END"


@query(f"SELECT id, {_TIERS} AS tier, least(score / 10, 0.9)::DOUBLE AS confidence FROM ({ORACLE_SCORE})")
def python_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tier and confidence of the additive score."""
    score = F.col("score")
    return CODE["signal_score"](spark, d).select(
        "id", F.when(score >= 6, "medium").when(score >= 4, "low").otherwise("none").alias("tier"), F.least(score / 10, F.lit(0.9)).alias("confidence")
    )


@query(f"""
    SELECT id, repo, file, score FROM (SELECT s.id, n.repo, n.file, s.score, row_number() OVER (PARTITION BY n.repo, n.file ORDER BY s.score DESC, s.id) AS r FROM ({ORACLE_SCORE}) s JOIN nodes n ON n.id = s.id WHERE n.file IS NOT NULL)
    WHERE r <= 2 ORDER BY score DESC, id LIMIT 40""")
def top_overall(spark: SparkSession, d: str) -> DataFrame:
    """The forty best functions, at most two of a file."""
    from quarrylens.operators import funnel

    n = table(spark, d, "nodes").where("file is not null").select("id", "repo", "file")
    scored = CODE["signal_score"](spark, d).select("id", "score").join(n, "id")
    best = funnel.cap_per(scored, ["repo", "file"], [F.col("score").desc(), F.col("id")], 2)
    return best.orderBy(F.col("score").desc(), "id").limit(40).select("id", "repo", "file", "score")


@query("""
    SELECT lower(trim(source)) AS source, count(*) AS input, count_if(coalesce(da_survived, false)) AS survivors, count_if(NOT coalesce(da_survived, false)) AS rejected,
      round(count_if(coalesce(da_survived, false)) / count(*), 6) AS ratio, count_if(coalesce(da_survived, false)) / count(*) < 0.05 AS alarm FROM da_results GROUP BY 1""")
def stage_split(spark: SparkSession, d: str) -> DataFrame:
    """Survivors and rejected rows of a stage, which together are its input, their ratio, and an alarm below five percent."""
    keep = F.coalesce("da_survived", F.lit(False))
    ratio = F.count_if(keep) / F.count(F.lit(1))
    return table(spark, d, "da_results").groupBy(F.lower(F.trim("source")).alias("source")).agg(
        F.count(F.lit(1)).alias("input"), F.count_if(keep).alias("survivors"), F.count_if(~keep).alias("rejected"), F.round(ratio, 6).alias("ratio"), (ratio < 0.05).alias("alarm")
    )


@query(f"""
    WITH f AS (SELECT repo, file, sum(length(code)) AS size, bool_or(regexp_matches(code, 'eval|exec|system|execute')) AS hit FROM nodes WHERE code <> '' AND file IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY size DESC, file) AS place FROM f)
    SELECT repo, min((place, file))[2] AS file, min(place)::INT AS place FROM r WHERE place <= 5 AND hit GROUP BY 1""")
def first_hit_files(spark: SparkSession, d: str) -> DataFrame:
    """Of the five largest files of a repository the first that holds a sink: what a scan that stops at a hit would report."""
    f = table(spark, d, "nodes").where("code <> '' and file is not null").groupBy("repo", "file").agg(
        F.sum(F.length("code")).alias("size"), F.bool_or(F.col("code").rlike("eval|exec|system|execute")).alias("hit")
    )
    place = F.row_number().over(W.partitionBy("repo").orderBy(F.col("size").desc(), "file"))
    first = F.min(F.struct("place", "file")).alias("b")
    return f.withColumn("place", place).where("place <= 5 and hit").groupBy("repo").agg(first).select("repo", "b.file", "b.place")


@query("""
    WITH h AS (SELECT n.repo, n.id, n.file || ':' || coalesce(n.start_line, 1) || ' ' || coalesce(nullif(n.sink_kind, ''), 'none') AS hit, row_number() OVER (PARTITION BY n.repo ORDER BY n.id) AS r FROM nodes n WHERE n.is_sink AND n.file IS NOT NULL)
    SELECT repo, count(*) AS hits, string_agg(hit, chr(10) ORDER BY id) AS text FROM h WHERE r <= 20 GROUP BY 1""")
def static_hits(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty sinks of a repository as a text."""
    from quarrylens.operators import funnel

    n = table(spark, d, "nodes").where("is_sink and file is not null")
    hit = F.concat("file", F.lit(":"), F.coalesce("start_line", F.lit(1)).cast("string"), F.lit(" "), F.coalesce(F.nullif(F.col("sink_kind"), F.lit("")), F.lit("none")))
    first = funnel.cap_per(n.select("repo", "id", hit.alias("hit")), ["repo"], [F.col("id")], 20)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", "hit"))), lambda h: h.hit)
    return first.groupBy("repo").agg(F.count(F.lit(1)).alias("hits"), F.array_join(lines, "\n").alias("text"))


@query("""
    WITH k AS (SELECT candidate_id, vuln_id, substr(coalesce(description, root_cause, ''), 1, 70) AS summary, row_number() OVER (PARTITION BY candidate_id ORDER BY vuln_id) AS r FROM vulns WHERE candidate_id IS NOT NULL)
    SELECT candidate_id, count(*) AS known, string_agg('- ' || vuln_id || ': ' || summary, chr(10) ORDER BY vuln_id) AS section FROM k WHERE r <= 5 GROUP BY 1""")
def known_sections(spark: SparkSession, d: str) -> DataFrame:
    """The first five known findings of a package, seventy characters each."""
    from quarrylens.operators import funnel

    v = table(spark, d, "vulns").where("candidate_id is not null").select("candidate_id", "vuln_id", F.substring(F.coalesce("description", "root_cause", F.lit("")), 1, 70).alias("summary"))
    first = funnel.cap_per(v, ["candidate_id"], [F.col("vuln_id")], 5)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("vuln_id", "summary"))), lambda h: F.concat(F.lit("- "), h.vuln_id.cast("string"), F.lit(": "), h.summary))
    return first.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("known"), F.array_join(lines, "\n").alias("section"))


@query("""
    SELECT repo, CASE WHEN count(DISTINCT CASE WHEN regexp_matches(lower(file), '[.](js|ts|jsx|tsx|mjs|cjs)$') THEN file END) > count(DISTINCT CASE WHEN lower(file) LIKE '%.py' THEN file END) THEN 'javascript' ELSE 'python' END AS language
    FROM nodes WHERE file IS NOT NULL GROUP BY 1""")
def majority_language(spark: SparkSession, d: str) -> DataFrame:
    """Scripts only where they are more than Python files, else Python."""
    scripts, python = F.countDistinct(F.when(T.is_script("file"), F.col("file"))), F.countDistinct(F.when(F.lower("file").endswith(".py"), F.col("file")))
    return table(spark, d, "nodes").where("file is not null").groupBy("repo").agg(F.when(scripts > python, "javascript").otherwise("python").alias("language"))


@query("""
    SELECT vuln_id, CASE s WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS gate_rank, CASE s WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS report_rank
    FROM (SELECT vuln_id, CASE WHEN cvss_score IS NULL THEN 'unknown' WHEN cvss_score >= 9 THEN 'critical' WHEN cvss_score >= 7 THEN 'high' WHEN cvss_score >= 4 THEN 'medium' ELSE 'low' END AS s FROM vulns)""")
def severity_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The two orders of severity: gates count an unknown one as low, reports rank it below."""
    from quarrylens.operators import funnel

    v = table(spark, d, "vulns").select("vuln_id", funnel.severity("cvss_score").alias("s"))
    report = F.coalesce(F.create_map(*(F.lit(x) for kv in {"critical": 4, "high": 3, "medium": 2, "low": 1}.items() for x in kv))[F.col("s")], F.lit(0))
    return v.select("vuln_id", funnel.severity_rank("s").alias("gate_rank"), report.alias("report_rank"))


ORACLE["chunk_brace_blocks"] = ORACLE["brace_blocks"]  # the same rows under the name of the first round
