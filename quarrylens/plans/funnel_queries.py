"""Queries over findings, reviews, runs and documents. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens import dims
from quarrylens.functions import text as T
from quarrylens.operators import emit, funnel, running
from quarrylens.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_SEVERITY = "CASE WHEN cvss_score IS NULL THEN 'unknown' WHEN cvss_score >= 9 THEN 'critical' WHEN cvss_score >= 7 THEN 'high' WHEN cvss_score >= 4 THEN 'medium' ELSE 'low' END"
_RANK = "CASE WHEN severity IS NULL THEN NULL WHEN severity = 'critical' THEN 4 WHEN severity = 'high' THEN 3 WHEN severity = 'medium' THEN 2 ELSE 1 END"


@query("""
    SELECT da_id, obj IS NOT NULL AS has_object, CASE WHEN obj IS NOT NULL AND json_valid(obj) THEN 'parsed' WHEN obj IS NOT NULL THEN 'broken' ELSE 'text' END AS outcome
    FROM (SELECT da_id, nullif(regexp_extract(rebuttal, '(?s)(\\{.*\\})', 1), '') AS obj FROM da_results WHERE rebuttal IS NOT NULL)""")
def verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    """Verdict objects inside review texts: parsed, broken or plain text."""
    rows = table(spark, d, "da_results").where("rebuttal is not null").select("da_id", T.json_object("rebuttal").alias("obj"))
    parsed = F.expr("try_parse_json(obj)").isNotNull()
    return rows.select("da_id", F.col("obj").isNotNull().alias("has_object"), F.when(F.col("obj").isNull(), "text").when(parsed, "parsed").otherwise("broken").alias("outcome"))


@query("""
    SELECT event_id, event_type, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE json_valid(props)""")
def event_fields(spark: SparkSession, d: str) -> DataFrame:
    """A field of the JSON column, null where it is absent or no number."""
    return table(spark, d, "events").where("try_parse_json(props) is not null").select(
        "event_id", "event_type", F.expr("try_variant_get(try_parse_json(props), '$.k', 'int')").alias("k")
    )


@query("""
    SELECT run_id, try_cast(nullif(regexp_extract(stdout, 'line ([0-9]+)', 1), '') AS INT) AS line, try_cast(nullif(regexp_extract(error_msg, '([0-9]+)', 1), '') AS INT) AS number FROM poc_results""")
def coerce_lines(spark: SparkSession, d: str) -> DataFrame:
    """Numbers read from text, null where there are none."""
    return table(spark, d, "poc_results").select(
        "run_id", F.expr("try_cast(nullif(regexp_extract(stdout, 'line ([0-9]+)', 1), '') as int)").alias("line"), T.first_integer("error_msg").alias("number")
    )


@query("""
    SELECT run_id, vuln_id, regexp_matches(stdout, '(^|\\n)VULNERABLE:') AS said, nullif(regexp_extract(stdout, 'VULNERABLE: ([^\\n]*)', 1), '') AS evidence_line,
      coalesce(exit_code = 0, false) AS ok FROM poc_results WHERE stdout IS NOT NULL""")
def run_predicates(spark: SparkSession, d: str) -> DataFrame:
    """What the output of a run says."""
    return table(spark, d, "poc_results").where("stdout is not null").select(
        "run_id", "vuln_id", F.col("stdout").rlike("(^|\\n)VULNERABLE:").alias("said"),
        F.nullif(F.regexp_extract("stdout", "VULNERABLE: ([^\\n]*)", 1), F.lit("")).alias("evidence_line"),
        F.coalesce(F.col("exit_code") == 0, F.lit(False)).alias("ok"),
    )


@query(f"SELECT vuln_id, coalesce(lower(trim(vuln_type)), 'other') AS vuln_type, confidence FROM vulns WHERE coalesce(confidence, 0.0) >= {dims.CONFIDENCE_CUTOFF}")
def confidence_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Findings of enough confidence; an absent one is 0."""
    return table(spark, d, "vulns").where(F.coalesce("confidence", F.lit(0.0)) >= dims.CONFIDENCE_CUTOFF).select(
        "vuln_id", F.coalesce(F.lower(F.trim("vuln_type")), F.lit("other")).alias("vuln_type"), "confidence"
    )


_LATEST_RUN = "SELECT vuln_id, arg_max(run_id, row(ran_at, run_id)) AS run_id, arg_max(vulnerable, row(ran_at, run_id)) AS vulnerable FROM (SELECT vuln_id, run_id, ran_at, coalesce(vulnerable, false) AS vulnerable FROM poc_results) WHERE vuln_id IS NOT NULL GROUP BY 1"
_LATEST_DA = "SELECT vuln_id, arg_max(da_id, row(reviewed_at, da_id)) AS da_id, arg_max(survived, row(reviewed_at, da_id)) AS survived FROM (SELECT vuln_id, da_id, reviewed_at, coalesce(da_survived, true) AS survived FROM da_results) WHERE vuln_id IS NOT NULL GROUP BY 1"


def _latest(spark: SparkSession, d: str):
    runs = funnel.latest(
        table(spark, d, "poc_results").select("vuln_id", "ran_at", "run_id", F.coalesce("vulnerable", F.lit(False)).alias("vulnerable")), "vuln_id", ["ran_at", "run_id"]
    )
    reviews = funnel.latest(
        table(spark, d, "da_results").select("vuln_id", "reviewed_at", "da_id", F.coalesce("da_survived", F.lit(True)).alias("survived")), "vuln_id", ["reviewed_at", "da_id"]
    )
    return runs.drop("ran_at"), reviews.drop("reviewed_at")


@query(f"""
    SELECT v.vuln_id, v.candidate_id, r.run_id, a.da_id, coalesce(r.vulnerable, false) AS vulnerable, coalesce(a.survived, true) AS survived
    FROM vulns v LEFT JOIN ({_LATEST_RUN}) r USING (vuln_id) LEFT JOIN ({_LATEST_DA}) a USING (vuln_id)""")
def verdict_join(spark: SparkSession, d: str) -> DataFrame:
    """Findings with their last run and last review; without one they count as not shown and as surviving."""
    runs, reviews = _latest(spark, d)
    return table(spark, d, "vulns").select("vuln_id", "candidate_id").join(runs, "vuln_id", "left").join(reviews, "vuln_id", "left").select(
        "vuln_id", "candidate_id", "run_id", "da_id", F.coalesce("vulnerable", F.lit(False)).alias("vulnerable"), F.coalesce("survived", F.lit(True)).alias("survived")
    )


@query(f"""
    SELECT v.vuln_id, v.candidate_id, lower(trim(v.vuln_type)) AS vuln_type FROM vulns v WHERE v.vuln_type IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM vulns c JOIN ({_LATEST_RUN}) r USING (vuln_id) WHERE r.vulnerable AND c.candidate_id = v.candidate_id AND lower(trim(c.vuln_type)) = lower(trim(v.vuln_type)))""")
def unconfirmed_types(spark: SparkSession, d: str) -> DataFrame:
    """Findings of a package whose type no run has shown there."""
    v = table(spark, d, "vulns").where("vuln_type is not null").select("vuln_id", "candidate_id", F.lower(F.trim("vuln_type")).alias("vuln_type"))
    shown = v.join(_latest(spark, d)[0].where("vulnerable"), "vuln_id", "left_semi").select("candidate_id", "vuln_type").distinct()
    return v.join(shown, ["candidate_id", "vuln_type"], "left_anti").select("vuln_id", "candidate_id", "vuln_type")


@query("""
    SELECT vuln_id, first_id, copies FROM (
      SELECT vuln_id, min(vuln_id) OVER (PARTITION BY k) AS first_id, count(*) OVER (PARTITION BY k) AS copies FROM (
        SELECT vuln_id, md5(concat_ws('|', candidate_id, lower(trim(coalesce(description, ''))), lower(trim(coalesce(root_cause, ''))))) AS k FROM vulns)) WHERE vuln_id <> first_id""")
def known_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Findings told before for the same package, word for word."""
    key = F.md5(F.concat_ws("|", "candidate_id", F.lower(F.trim(F.coalesce("description", F.lit("")))), F.lower(F.trim(F.coalesce("root_cause", F.lit(""))))))
    v = table(spark, d, "vulns").select("vuln_id", key.alias("k"))
    first = v.groupBy("k").agg(F.min("vuln_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return v.join(first, "k").where("vuln_id <> first_id").select("vuln_id", "first_id", "copies")


@query(f"""
    WITH j AS (SELECT v.*, coalesce(r.vulnerable, false) AS vulnerable, coalesce(a.survived, true) AS survived FROM vulns v LEFT JOIN ({_LATEST_RUN}) r USING (vuln_id) LEFT JOIN ({_LATEST_DA}) a USING (vuln_id))
    SELECT coalesce(source, 'unknown') AS source, count(*) AS found, count_if(confidence >= 0.5) AS confident, count_if(confidence >= 0.5 AND survived) AS survived, count_if(confidence >= 0.5 AND survived AND vulnerable) AS shown,
      count_if(confidence >= 0.5 AND survived AND vulnerable)::DOUBLE / nullif(count(*), 0) AS ratio FROM j GROUP BY 1""")
def funnel_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many findings pass each stage, per source, and the share that is left."""
    runs, reviews = _latest(spark, d)
    j = table(spark, d, "vulns").select("vuln_id", "source", "confidence").join(runs, "vuln_id", "left").join(reviews, "vuln_id", "left")
    sure = F.col("confidence") >= 0.5
    survived, shown = F.coalesce("survived", F.lit(True)), F.coalesce("vulnerable", F.lit(False))
    return j.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count(F.lit(1)).alias("found"), F.count_if(sure).alias("confident"), F.count_if(sure & survived).alias("survived"),
        F.count_if(sure & survived & shown).alias("shown"), (F.count_if(sure & survived & shown) / F.count(F.lit(1))).alias("ratio"),
    )


@query(f"""
    WITH s AS (SELECT candidate_id, {_SEVERITY} AS severity FROM vulns)
    SELECT g.id AS candidate_id, coalesce(max({_RANK}), 0)::INT AS rank, coalesce(max({_RANK}), 0) < 3 AS passes FROM registry g LEFT JOIN s ON s.candidate_id = g.id GROUP BY 1""")
def severity_gate(spark: SparkSession, d: str) -> DataFrame:
    """Highest severity of each package and whether a gate at high lets it pass; none passes."""
    worst = table(spark, d, "vulns").select("candidate_id", funnel.severity("cvss_score").alias("severity")).groupBy("candidate_id").agg(
        F.max(funnel.severity_rank("severity")).alias("rank")
    )
    rank = F.coalesce("rank", F.lit(0))
    return table(spark, d, "registry").select(F.col("id").alias("candidate_id")).join(worst, "candidate_id", "left").select(
        "candidate_id", rank.alias("rank"), (rank < 3).alias("passes")
    )


@query(f"SELECT {_SEVERITY} AS severity, count(*) AS n FROM vulns GROUP BY 1")
def severity_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vulns").groupBy(funnel.severity("cvss_score").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH j AS (SELECT coalesce(lower(trim(v.vuln_type)), 'other') AS vuln_type, r.vulnerable AS truth, coalesce(v.confidence, 0) >= 0.5 AS said FROM vulns v JOIN ({_LATEST_RUN}) r USING (vuln_id))
    SELECT vuln_type, count(*) AS n, count_if(truth) AS positive, count_if(truth AND said) AS hit, count_if(truth AND said)::DOUBLE / nullif(count_if(truth), 0) AS recall,
      count_if(truth AND said)::DOUBLE / nullif(count_if(said), 0) AS "precision" FROM j GROUP BY 1""")
def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Recall and precision of confident findings against runs, per type."""
    j = table(spark, d, "vulns").join(_latest(spark, d)[0], "vuln_id").select(
        F.coalesce(F.lower(F.trim("vuln_type")), F.lit("other")).alias("vuln_type"), F.col("vulnerable").alias("truth"), (F.coalesce("confidence", F.lit(0.0)) >= 0.5).alias("said")
    )
    hit = F.count_if(F.col("truth") & F.col("said"))
    return j.groupBy("vuln_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("truth").alias("positive"), hit.alias("hit"),
        (hit / F.nullif(F.count_if("truth"), F.lit(0))).alias("recall"), (hit / F.nullif(F.count_if("said"), F.lit(0))).alias("precision"),
    )


@query("""
    SELECT run_id, source, cost, spent_before::BIGINT AS spent_before, spent_before < 20000 AS runs, spent_before >= 16000 AS warns FROM (
      SELECT run_id, source, cost, coalesce(sum(cost) OVER (PARTITION BY source ORDER BY ran_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_before
      FROM (SELECT run_id, source, ran_at, (length(coalesce(stdout, '')) // 4)::INT AS cost FROM poc_results WHERE ran_at IS NOT NULL))""")
def running_budget(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each source in order until a budget is spent; the one that crosses it still runs."""
    rows = table(spark, d, "poc_results").where("ran_at is not null").select(
        "run_id", "source", "ran_at", F.floor(F.length(F.coalesce("stdout", F.lit(""))) / 4).cast("int").alias("cost")
    )
    return funnel.running_budget(rows, "source", ["ran_at", "run_id"], "cost", 20000, F.date_trunc("hour", "ran_at")).drop("ran_at")


@query("""
    SELECT source, count(*) AS calls, sum(length(coalesce(rebuttal, '')))::BIGINT AS chars, sum(length(coalesce(rebuttal, '')) // 4)::BIGINT AS tokens FROM da_results GROUP BY 1""")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(F.coalesce("rebuttal", F.lit("")))
    return table(spark, d, "da_results").groupBy("source").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(n).alias("chars"), F.sum(F.floor(n / 4)).alias("tokens")
    )


@query("""
    SELECT vuln_id, da_id, source FROM (SELECT vuln_id, da_id, source, row_number() OVER (PARTITION BY vuln_id ORDER BY reviewed_at DESC NULLS LAST, da_id DESC) AS r FROM da_results WHERE vuln_id IS NOT NULL) WHERE r <= 3""")
def last_reviews(spark: SparkSession, d: str) -> DataFrame:
    """The last three reviews of each finding."""
    rows = table(spark, d, "da_results").where("vuln_id is not null").select("vuln_id", "da_id", "source", "reviewed_at")
    return funnel.cap_per(rows, ["vuln_id"], [F.col("reviewed_at").desc_nulls_last(), F.col("da_id").desc()], 3).select("vuln_id", "da_id", "source")


@query("""
    SELECT vuln_id, candidate_id, ((row_number() OVER (PARTITION BY candidate_id ORDER BY vuln_id) - 1) // 6)::INT AS batch, row_number() OVER (PARTITION BY candidate_id ORDER BY vuln_id)::INT AS place FROM vulns""")
def micro_batches(spark: SparkSession, d: str) -> DataFrame:
    """Findings of a package in batches of six, with dense places."""
    rows = table(spark, d, "vulns").select("vuln_id", "candidate_id")
    place = running.sum_before(rows, ["candidate_id"], ["vuln_id"], F.floor(F.col("vuln_id") / 1000), F.lit(1), "before")
    return place.select("vuln_id", "candidate_id", (F.col("before") + 1).cast("int").alias("place")).select(
        "vuln_id", "candidate_id", F.floor((F.col("place") - 1) / 6).cast("int").alias("batch"), "place"
    )


@query("""
    SELECT repo, arg_max(language, row(n, language)) AS language, max(n) AS files FROM (
      SELECT repo, CASE WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.js' OR file LIKE '%.ts' THEN 'script' ELSE 'other' END AS language, count(DISTINCT file) AS n FROM nodes WHERE file IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def main_language(spark: SparkSession, d: str) -> DataFrame:
    """The language most files of a repository have."""
    kind = F.when(F.col("file").endswith(".py"), "python").when(F.col("file").rlike("\\.(js|ts)$"), "script").otherwise("other")
    each = table(spark, d, "nodes").where("file is not null").groupBy("repo", kind.alias("language")).agg(F.countDistinct("file").alias("n"))
    return each.groupBy("repo").agg(F.max_by("language", F.struct("n", "language")).alias("language"), F.max("n").alias("files"))


@query("""
    SELECT rule_id, min(vuln_id) AS first_id, arg_min(vuln_type, vuln_id) AS first_name, count(*) AS n FROM (
      SELECT vuln_id, vuln_type, replace(string_split(lower(trim(coalesce(nullif(vuln_type, ''), 'other'))), ' ')[1], ':', '') AS rule_id FROM vulns) GROUP BY 1""")
def distinct_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules, each described by its first finding."""
    v = table(spark, d, "vulns").select("vuln_id", "vuln_type", emit.rule_id("vuln_type").alias("rule_id"))
    named = v.where("vuln_type is not null")
    return v.groupBy("rule_id").agg(F.min("vuln_id").alias("first_id"), F.count(F.lit(1)).alias("n")).join(
        named.groupBy("rule_id").agg(F.min_by("vuln_type", "vuln_id").alias("first_name")), "rule_id", "left"
    ).select("rule_id", "first_id", "first_name", "n")


@query(f"""
    SELECT vuln_id, replace(string_split(lower(trim(coalesce(nullif(vuln_type, ''), 'other'))), ' ')[1], ':', '') AS rule_id,
      CASE {_SEVERITY} WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' ELSE 'warning' END AS level,
      substr(coalesce(nullif(root_cause, ''), nullif(description, ''), vuln_type, ''), 1, 1000) AS message, replace(affected_file, chr(92), '/') AS uri, greatest(coalesce(affected_line, 1), 1) AS start_line FROM vulns""")
def result_rows(spark: SparkSession, d: str) -> DataFrame:
    """Findings as flat report rows."""
    return emit.result_rows(table(spark, d, "vulns"))


@query(f"""
    SELECT vuln_id, replace(to_json({{'ruleId': rule_id, 'level': level, 'message': {{'text': message}}, 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': uri}}, 'region': {{'startLine': start_line}}}}}}]}})::VARCHAR,
      '{{"uri":null}}', '{{}}') AS result FROM ({ORACLE['result_rows']})""")
def result_json(spark: SparkSession, d: str) -> DataFrame:
    """Findings as nested JSON results."""
    return emit.result_json(emit.result_rows(table(spark, d, "vulns")))


@query(f"""
    SELECT vuln_id, concat_ws(chr(10), '## ' || rule_id || ' (' || level || ')', '', '- file: `' || coalesce(uri, 'unknown') || ':' || start_line || '`', '', message) AS section FROM ({ORACLE['result_rows']})""")
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    """Findings as Markdown sections."""
    return emit.markdown(emit.result_rows(table(spark, d, "vulns")))


@query("""
    SELECT v.vuln_id, r.package, r.ecosystem FROM vulns v JOIN (SELECT id, package, lower(trim(coalesce(ecosystem, 'unknown'))) AS ecosystem FROM registry) r ON r.id = v.candidate_id""")
def registry_join(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "registry").select(F.col("id").alias("candidate_id"), "package", F.lower(F.trim(F.coalesce("ecosystem", F.lit("unknown")))).alias("ecosystem"))
    return table(spark, d, "vulns").select("vuln_id", "candidate_id").join(r, "candidate_id").select("vuln_id", "package", "ecosystem")


@query("""
    SELECT n.repo, count(*) AS functions, bool_or(r.k IS NOT NULL) AS registered FROM nodes n LEFT JOIN (SELECT DISTINCT lower(package) AS k FROM registry) r ON r.k = lower(n.repo) GROUP BY 1""")
def registered_repos(spark: SparkSession, d: str) -> DataFrame:
    """Whether a repository is registered, in whatever letter case."""
    known = table(spark, d, "registry").select(F.lower("package").alias("k")).distinct().withColumn("known", F.lit(True))
    repos = table(spark, d, "nodes").groupBy("repo").agg(F.count(F.lit(1)).alias("functions"))
    return repos.join(known, F.lower("repo") == F.col("k"), "left").select("repo", "functions", F.coalesce("known", F.lit(False)).alias("registered"))
