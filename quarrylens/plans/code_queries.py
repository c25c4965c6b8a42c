"""Queries over code rows: scans, chunks, signals. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens import dims
from quarrylens.functions import text as T
from quarrylens.operators import chunks, funnel, signals
from quarrylens.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _q(text: str) -> str:
    return text.replace("'", "''")


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


LINES = "string_split(regexp_replace(replace({c}, chr(13), ''), '\n$', ''), chr(10))"
LANG = "CASE " + " ".join(f"WHEN lower(regexp_extract({{p}}, '\\.([A-Za-z0-9]+)$', 1)) = '{e}' THEN '{l}'" for e, l in dims.LANGUAGES.items()) + " ELSE 'other' END"


def _kinds(patterns: dict[str, str], c: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({c}, '{_q(p)}') THEN '{k}' END" for k, p in patterns.items()) + ")"


SCAN_PATTERNS = {"advisory": "severity: (high|critical)", "path": "[a-z]+/[a-z_]+\\.(py|js|ts|go)", "version": "[0-9]+\\.[0-9]+\\.[0-9]+", "call": "[a-z_]+\\(\\)"}


@query(f"""
    WITH l AS (SELECT lower(trim(source)) AS source, doc_id, unnest({LINES.format(c='text')}) AS line FROM documents WHERE text IS NOT NULL),
    s AS (SELECT source, doc_id, sum({' + '.join(f"(CASE WHEN regexp_matches(lower(line), '{_q(p)}') THEN {w} ELSE 0 END)" for p, w in zip(SCAN_PATTERNS.values(), (9, 2, 1, 1)))}) AS score
          FROM l GROUP BY 1, 2),
    c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM s WHERE score >= 2),
    g AS (SELECT source, CASE WHEN score >= 12 THEN 'high' WHEN score >= 6 THEN 'medium' ELSE 'low' END AS severity FROM c WHERE r <= 50)
    SELECT source, severity, count(*) AS documents FROM g GROUP BY 1, 2""")
def scan_severity(spark: SparkSession, d: str) -> DataFrame:
    """Line signals of documents, summed to a score, the best of each source, counted by severity."""
    points = lambda line: sum(
        (F.when(line.rlike(p), w).otherwise(0) for p, w in zip(SCAN_PATTERNS.values(), (9, 2, 1, 1))), F.lit(0)
    )
    scored = table(spark, d, "documents").where("text is not null").select(
        F.lower(F.trim("source")).alias("source"), "doc_id", F.aggregate(T.lines(F.lower("text")), F.lit(0), lambda n, x: n + points(x)).alias("score")
    ).where("score >= 2")
    best = funnel.cap_per(scored, ["source"], [F.col("score").desc(), F.col("doc_id")], 50)
    severity = F.when(F.col("score") >= 12, "high").when(F.col("score") >= 6, "medium").otherwise("low").alias("severity")
    return best.groupBy("source", severity).agg(F.count(F.lit(1)).alias("documents"))


@query(f"""
    SELECT repo, file, count(*) AS functions, sum(coalesce(length(code), 0))::BIGINT AS chars FROM nodes
    WHERE lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) IN ({_in(dims.LANGUAGES)}) AND len(list_filter(string_split(file, '/'), lambda x: x IN ({_in(dims.SKIP_DIRS)}))) = 0
    GROUP BY 1, 2 HAVING sum(coalesce(length(code), 0)) <= 300000""")
def scan_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of known languages outside skipped directories, up to a size."""
    skip = F.array(*(F.lit(x) for x in dims.SKIP_DIRS))
    kept = table(spark, d, "nodes").where(T.extension("file").isin(*dims.LANGUAGES) & ~F.arrays_overlap(F.split("file", "/"), skip))
    return kept.groupBy("repo", "file").agg(
        F.count(F.lit(1)).alias("functions"), F.sum(F.coalesce(F.length("code"), F.lit(0))).alias("chars")
    ).where("chars <= 300000")


@query(f"""
    SELECT language, origin, count(*) AS n FROM (
      SELECT 'nodes' AS origin, {LANG.format(p='file')} AS language FROM nodes
      UNION ALL SELECT 'func_nodes', {LANG.format(p='file_path')} FROM func_nodes
      UNION ALL SELECT 'code_chunks', {LANG.format(p='file_path')} FROM code_chunks) GROUP BY 1, 2""")
def scan_languages(spark: SparkSession, d: str) -> DataFrame:
    """Union of the scans by language."""
    parts = [
        table(spark, d, t).select(F.lit(t).alias("origin"), T.language(c).alias("language"))
        for t, c in (("nodes", "file"), ("func_nodes", "file_path"), ("code_chunks", "file_path"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("language", "origin").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH r AS (SELECT repo, doc_id, lower(trim(source)) AS source, substr(text, 1, 4000) AS head,
      row_number() OVER (PARTITION BY repo ORDER BY CASE lower(trim(source)) WHEN 'readme' THEN 0 WHEN 'report' THEN 1 WHEN 'devlog' THEN 2 ELSE 3 END, doc_id) AS k
      FROM documents WHERE repo IS NOT NULL AND text <> '')
    SELECT repo, doc_id, source, length(head)::INT AS chars FROM r WHERE k = 1""")
def scan_readme(spark: SparkSession, d: str) -> DataFrame:
    """Per repository the first document by kind, cut to what a summary reads."""
    rank = F.when(F.col("source") == "readme", 0).when(F.col("source") == "report", 1).when(F.col("source") == "devlog", 2).otherwise(3)
    docs = table(spark, d, "documents").where("repo is not null and text <> ''").select(
        "repo", "doc_id", F.lower(F.trim("source")).alias("source"), F.length(F.substring("text", 1, 4000)).alias("chars")
    )
    return docs.groupBy("repo").agg(F.min_by(F.struct("doc_id", "source", "chars"), F.struct(rank, "doc_id")).alias("b")).select("repo", "b.*")


@query("""
    WITH f AS (SELECT repo, file, sum(length(code))::BIGINT AS chars FROM nodes WHERE code IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY chars DESC, file) AS k FROM f)
    SELECT repo, file, chars, k::INT AS place FROM r WHERE k <= 5""")
def scan_largest_files(spark: SparkSession, d: str) -> DataFrame:
    """The five largest files of each repository."""
    files = table(spark, d, "nodes").where("code is not null").groupBy("repo", "file").agg(F.sum(F.length("code")).alias("chars"))
    place = F.row_number().over(W.partitionBy("repo").orderBy(F.col("chars").desc(), "file"))
    return files.withColumn("place", place).where("place <= 5")


@query("""
    WITH v AS (SELECT vuln_id, replace(affected_file, chr(92), '/') AS path, regexp_extract(replace(affected_file, chr(92), '/'), '([^/]+)$', 1) AS base FROM vulns WHERE affected_file IS NOT NULL),
    f AS (SELECT DISTINCT file, regexp_extract(file, '([^/]+)$', 1) AS base FROM nodes WHERE file IS NOT NULL),
    e AS (SELECT vuln_id, min(file) AS exact_file FROM v JOIN f ON v.path = f.file GROUP BY 1),
    b AS (SELECT vuln_id, min(file) AS base_file FROM v JOIN f ON lower(v.base) = lower(f.base) GROUP BY 1)
    SELECT v.vuln_id, coalesce(exact_file, base_file) AS file, CASE WHEN exact_file IS NOT NULL THEN 'path' WHEN base_file IS NOT NULL THEN 'name' ELSE 'none' END AS by
    FROM v LEFT JOIN e USING (vuln_id) LEFT JOIN b USING (vuln_id)""")
def resolve_paths(spark: SparkSession, d: str) -> DataFrame:
    """The file a finding means: by its path, else by its name."""
    v = table(spark, d, "vulns").where("affected_file is not null").select(
        "vuln_id", F.regexp_replace("affected_file", "\\\\", "/").alias("path"), F.lower(T.basename("affected_file")).alias("base")
    )
    f = table(spark, d, "nodes").where("file is not null").select("file").distinct()
    exact = v.join(f, v.path == f.file).groupBy("vuln_id").agg(F.min("file").alias("exact_file"))
    named = f.groupBy(F.lower(T.basename("file")).alias("base")).agg(F.min("file").alias("base_file"))
    return v.join(exact, "vuln_id", "left").join(named, "base", "left").select(
        "vuln_id", F.coalesce("exact_file", "base_file").alias("file"),
        F.when(F.col("exact_file").isNotNull(), "path").when(F.col("base_file").isNotNull(), "name").otherwise("none").alias("by"),
    )


@query("""
    SELECT run_id, source, CASE WHEN len(m) = 0 THEN NULL ELSE list_sum(list_transform(m, lambda x: x::BIGINT))::BIGINT END AS checked FROM (
      SELECT run_id, source, regexp_extract_all(stdout, 'checked ([0-9]+) of', 1) AS m FROM poc_results WHERE stdout IS NOT NULL)""")
def log_totals(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a log pattern summed per log; null where the pattern is absent."""
    found = F.regexp_extract_all("stdout", F.lit("checked ([0-9]+) of"), F.lit(1))
    total = F.aggregate(F.transform("m", lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, d, "poc_results").where("stdout is not null").withColumn("m", found).select(
        "run_id", "source", F.when(F.size("m") > 0, total).alias("checked")
    )


@query(f"""
    WITH l AS (SELECT id, {LINES.format(c='code')} AS ls FROM nodes WHERE code IS NOT NULL),
    s AS (SELECT id, ls, unnest(range(0, greatest(len(ls), 1), {dims.CHUNK_WINDOW - dims.CHUNK_OVERLAP})) AS st FROM l),
    w AS (SELECT id, st, (st + 1)::INT AS start_line, least(st + {dims.CHUNK_WINDOW}, len(ls))::INT AS end_line, array_to_string(ls[st + 1 : st + {dims.CHUNK_WINDOW}], chr(10)) AS chunk
          FROM s WHERE st = 0 OR st + {dims.CHUNK_OVERLAP} < len(ls))
    SELECT id, (row_number() OVER (PARTITION BY id ORDER BY st) - 1)::INT AS chunk_no, start_line, end_line, md5(chunk) AS digest FROM w
    WHERE length(regexp_replace(chunk, '[ \\t\\n]', '', 'g')) > 0""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    cut = chunks.line_windows(table(spark, d, "nodes"), "id", "code")
    return cut.select("id", "chunk_no", "start_line", "end_line", F.md5("chunk").alias("digest"))


@query(f"""
    SELECT chunk_id, md5(array_to_string(({LINES.format(c='code')})[1:30], chr(10))) AS head, len({LINES.format(c='code')})::INT AS n_lines
    FROM code_chunks WHERE code IS NOT NULL""")
def chunk_heads(spark: SparkSession, d: str) -> DataFrame:
    """The first thirty lines of each chunk, as context for what follows."""
    return table(spark, d, "code_chunks").where("code is not null").select("chunk_id", T.lines("code").alias("ls")).select(
        "chunk_id", F.md5(F.array_join(F.slice("ls", 1, 30), "\n")).alias("head"), F.size("ls").alias("n_lines")
    )


@query(f"""
    WITH l AS (SELECT id, {LINES.format(c='code')} AS ls FROM nodes WHERE regexp_matches(code, '\\.execute\\(')),
    p AS (SELECT id, ls, list_position(list_transform(ls, lambda x: regexp_matches(x, '\\.execute\\(')), true)::INT AS line FROM l)
    SELECT id, line, array_to_string(list_transform(range(greatest(line - 2, 1), least(line + 2, len(ls)) + 1), lambda i: concat(i::VARCHAR, ': ', ls[i])), chr(10)) AS snippet
    FROM p WHERE line > 0""")
def chunk_snippets(spark: SparkSession, d: str) -> DataFrame:
    return chunks.snippets(table(spark, d, "nodes"), "id", "code", "\\.execute\\(")


@query()
def chunk_brace_blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.brace_blocks(table(spark, d, "nodes"), "id", "code")


@query("""
    SELECT id, repo, used_before::BIGINT AS used_before FROM (
      SELECT id, repo, coalesce(sum(n) OVER (PARTITION BY repo ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_before
      FROM (SELECT id, repo, length(code) AS n FROM nodes WHERE code <> ''))
    WHERE used_before < 8000""")
def chunk_budget(spark: SparkSession, d: str) -> DataFrame:
    """Functions of a repository, in order, that fit a budget of characters."""
    rows = table(spark, d, "nodes").where("code <> ''").select("id", "repo", F.length("code").alias("n"))
    return chunks.within_budget(rows, "repo", ["id"], "n", 8000, F.floor(F.col("id") / 1000)).select("id", "repo", "used_before")


@query("""
    SELECT id, name FROM (SELECT DISTINCT id, unnest(regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]*) *\\(', 1)) AS name FROM nodes WHERE code <> '')""")
def chunk_calls(spark: SparkSession, d: str) -> DataFrame:
    """Names called in each function."""
    return table(spark, d, "nodes").where("code <> ''").select("id", F.explode(F.array_distinct(T.called_names("code"))).alias("name"))


@query(f"""
    SELECT repo, file, count(*) AS functions, sum(len({LINES.format(c='code')}))::BIGINT AS n_lines, count(DISTINCT name) AS names
    FROM nodes WHERE code <> '' GROUP BY 1, 2""")
def file_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").where("code <> ''").groupBy("repo", "file").agg(
        F.count(F.lit(1)).alias("functions"), F.sum(F.size(T.lines("code"))).alias("n_lines"), F.countDistinct("name").alias("names")
    )


@query("""
    SELECT id, concat(file, ':', coalesce(start_line::VARCHAR, '?'), '-', coalesce(end_line::VARCHAR, '?')) AS location,
      md5(concat_ws(chr(10), concat('# ', file), concat('# ', coalesce(name, '')), substr(code, 1, 3000))) AS prompt
    FROM nodes WHERE code <> '' AND file IS NOT NULL""")
def prompt_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Text handed to a scorer: location, name and the first 3000 characters of the code."""
    place = F.concat("file", F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("?")), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("?")))
    body = F.concat_ws("\n", F.concat(F.lit("# "), "file"), F.concat(F.lit("# "), F.coalesce("name", F.lit(""))), F.substring("code", 1, 3000))
    return table(spark, d, "nodes").where("code <> '' and file is not null").select("id", place.alias("location"), F.md5(body).alias("prompt"))


@query(f"""
    SELECT id, {_kinds(dims.SOURCE_PATTERNS, 'code')} AS sources, {_kinds(dims.DANGER_PATTERNS, 'code')} AS dangers FROM nodes
    WHERE code <> '' AND ({' OR '.join(f"regexp_matches(code, '{_q(p)}')" for p in [*dims.SOURCE_PATTERNS.values(), *dims.DANGER_PATTERNS.values()])})""")
def signal_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Sources and dangers in each function that has any."""
    return signals.annotate(table(spark, d, "nodes").where("code <> ''"), "code").where("sources <> '' or dangers <> ''").select("id", "sources", "dangers")


@query(f"""
    SELECT id, line_no, line FROM (SELECT id, unnest(range(1, len(ls) + 1))::INT AS line_no, unnest(ls) AS line FROM (SELECT id, {LINES.format(c='code')} AS ls FROM nodes WHERE code <> ''))
    WHERE regexp_matches(line, '{_q(dims.SECRET_LINE)}')""")
def signal_secret_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that give a literal to a name of a secret."""
    hit = table(spark, d, "nodes").where(F.col("code").rlike(dims.SECRET_LINE))
    return hit.select("id", F.posexplode(T.lines("code")).alias("i", "line")).where(F.col("line").rlike(dims.SECRET_LINE)).select(
        "id", (F.col("i") + 1).alias("line_no"), "line"
    )


@query(f"""
    WITH l AS (SELECT id, unnest(range(1, len(ls) + 1))::INT AS i, unnest(ls) AS x FROM (SELECT id, {LINES.format(c='code')} AS ls FROM nodes WHERE code <> '')),
    a AS (SELECT id, i FROM l WHERE regexp_matches(x, '\\.execute\\(')), b AS (SELECT id, i FROM l WHERE regexp_matches(x, '\\.decode\\('))
    SELECT a.id, a.i AS line, min(abs(a.i - b.i))::INT AS gap FROM a JOIN b USING (id) GROUP BY 1, 2 HAVING min(abs(a.i - b.i)) <= 5""")
def signal_proximity(spark: SparkSession, d: str) -> DataFrame:
    """Sinks within five lines of a source."""
    return signals.near(table(spark, d, "nodes").where("code <> ''"), "id", "code", "\\.execute\\(", "\\.decode\\(")


_SCORE = f"""(CASE WHEN regexp_matches(lower(name), '{dims.INTENT_NAME}') THEN 2.0 ELSE 0.0 END
  + CASE WHEN regexp_matches(code, 'req\\.body|request|payload|os\\.environ|process\\.env') THEN 1.5 ELSE 0.0 END
  + CASE WHEN regexp_matches(code, 'return (true|false|True|False|None|null|nil)') THEN 2.0 ELSE 0.0 END
  + CASE WHEN len(regexp_extract_all(code, '\\.(split|strip|trim|replace|startswith|decode|match)\\(', 1)) >= 2 THEN 1.5 ELSE 0.0 END
  + CASE WHEN name LIKE '\\_%' ESCAPE '\\' THEN 0.0 ELSE 0.5 END)::DOUBLE"""


@query(f"""
    SELECT id, score, CASE WHEN score >= 6 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score >= 2 THEN 'low' ELSE 'none' END AS tier
    FROM (SELECT id, {_SCORE} AS score FROM nodes WHERE code <> '' AND name IS NOT NULL)""")
def signal_score(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nodes").where("code <> '' and name is not null").withColumn("score", signals.score("name", "code"))
    return rows.select("id", "score", signals.tier("score").alias("tier"))


@query(f"""
    WITH s AS (SELECT id, repo, file, start_line, name, {_SCORE} AS score FROM nodes WHERE code <> '' AND name IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo, file ORDER BY score DESC, start_line NULLS FIRST, name, id) AS k FROM s WHERE score >= 4)
    SELECT id, repo, file, score FROM r WHERE k <= 2""")
def top_per_file(spark: SparkSession, d: str) -> DataFrame:
    """The two best-scored functions of each file."""
    rows = table(spark, d, "nodes").where("code <> '' and name is not null").withColumn("score", signals.score("name", "code")).where("score >= 4")
    order = [F.col("score").desc(), F.col("start_line"), F.col("name"), F.col("id")]
    return funnel.cap_per(rows.select("id", "repo", "file", "start_line", "name", "score"), ["repo", "file"], order, 2).select("id", "repo", "file", "score")


_SINK = "CASE " + " ".join(f"WHEN x IN ({_in(names)}) THEN '{k}'" for k, names in dims.SINK_CALLS) + " END"


@query(f"""
    SELECT id, (list_filter(list_transform(regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]*) *\\(', 1), lambda x: {_SINK}), lambda k: k IS NOT NULL))[1] AS sink_kind
    FROM nodes WHERE code <> ''""")
def tag_sinks(spark: SparkSession, d: str) -> DataFrame:
    """Kind of the first sink called in each function."""
    return table(spark, d, "nodes").where("code <> ''").select("id", signals.sink_kind("code").alias("sink_kind"))


@query(f"""
    SELECT id, name IN ({_in(dims.GATE_NAMES)}) AS named_gate, regexp_matches(lower(name), '{dims.GUARD_STEMS}') AS guard_like, coalesce(is_gate, false) AS is_gate
    FROM nodes WHERE name IS NOT NULL""")
def tag_gates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").where("name is not null").select(
        "id", F.col("name").isin(dims.GATE_NAMES).alias("named_gate"), F.lower("name").rlike(dims.GUARD_STEMS).alias("guard_like"),
        F.coalesce("is_gate", F.lit(False)).alias("is_gate"),
    )


@query("""
    SELECT id, repo, file, name FROM nodes WHERE name IS NOT NULL AND file IS NOT NULL
      AND NOT regexp_matches(lower(file), '(^|/)(tests?|spec|examples?|fixtures)/|_test\\.|test_') AND NOT regexp_matches(lower(name), '^test_|_test$')""")
def filter_tests(spark: SparkSession, d: str) -> DataFrame:
    """Functions outside test code."""
    return table(spark, d, "nodes").where("name is not null and file is not null").where(
        ~F.lower("file").rlike("(^|/)(tests?|spec|examples?|fixtures)/|_test\\.|test_") & ~F.lower("name").rlike("^test_|_test$")
    ).select("id", "repo", "file", "name")


@query(f"""
    WITH l AS (SELECT repo, file, id, unnest(range(1, len(ls) + 1))::INT AS line_no, unnest(ls) AS line FROM (SELECT repo, file, id, {LINES.format(c='code')} AS ls FROM nodes WHERE code <> '')),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY id, line_no) AS k FROM l WHERE regexp_matches(line, 'raise ValueError|throw new Error'))
    SELECT repo, id, line_no, line FROM r WHERE k <= 20""")
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty matching lines of each repository."""
    pattern = "raise ValueError|throw new Error"
    found = table(spark, d, "nodes").where(F.col("code").rlike(pattern)).select("repo", "id", F.posexplode(T.lines("code")).alias("i", "line"))
    found = found.where(F.col("line").rlike(pattern)).select("repo", "id", (F.col("i") + 1).alias("line_no"), "line")
    return funnel.cap_per(found, ["repo"], [F.col("id"), F.col("line_no")], 20)
