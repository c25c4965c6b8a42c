"""Report rows: flat results, nested JSON documents, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.operators import funnel

LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}


def rule_id(name: str) -> Column:
    return F.regexp_replace(F.split(F.lower(F.trim(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("other")))), " +")[0], ":", "")


def level(severity: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))
    return F.coalesce(table[severity], F.lit("warning"))


def result_rows(findings: DataFrame) -> DataFrame:
    """One result per finding: rule, level, message of at most 1000 characters, relative URI and line."""
    message = F.substring(F.coalesce(F.nullif(F.col("root_cause"), F.lit("")), F.nullif(F.col("description"), F.lit("")), F.col("vuln_type"), F.lit("")), 1, 1000)
    return findings.select(
        "vuln_id", rule_id("vuln_type").alias("rule_id"), level(funnel.severity("cvss_score")).alias("level"), message.alias("message"),
        F.regexp_replace("affected_file", "\\\\", "/").alias("uri"), F.greatest(F.coalesce("affected_line", F.lit(1)), F.lit(1)).alias("start_line"),
    )


def result_json(rows: DataFrame) -> DataFrame:
    """The nested form of each result, as JSON text."""
    place = F.struct(F.struct(
        F.struct(F.col("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")
    ).alias("physicalLocation"))
    doc = F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations")
    ))
    return rows.select("vuln_id", doc.alias("result"))


def markdown(rows: DataFrame) -> DataFrame:
    """A report section per finding."""
    return rows.select("vuln_id", F.concat_ws(
        "\n", F.concat(F.lit("## "), "rule_id", F.lit(" ("), "level", F.lit(")")), F.lit(""),
        F.concat(F.lit("- file: `"), F.coalesce("uri", F.lit("unknown")), F.lit(":"), F.col("start_line").cast("string"), F.lit("`")), F.lit(""), F.col("message"),
    ).alias("section"))


def documents(findings: DataFrame, per_document: int = 1000) -> DataFrame:
    """source, block, document: report documents with tool, distinct rules and results; one for each source and range of ids, so none outgrows a task."""
    rows = result_rows(findings).drop("rule_id").join(
        findings.select("vuln_id", F.lower(F.trim("source")).alias("source"), F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim("vuln_type")), "^([^ :]+)", 1), F.lit("")), F.lit("other")).alias("rule_id")),
        "vuln_id",
    )
    place = F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"),
        F.struct("vuln_id").alias("properties"),
    )
    grouped = rows.groupBy("source", F.floor(F.col("vuln_id") / per_document).alias("block")).agg(
        F.array_sort(F.collect_set("rule_id")).alias("rules"), F.array_sort(F.collect_list(result)).alias("results")
    )
    rules = F.transform("rules", lambda r: F.struct(r.alias("id"), r.alias("name"), F.struct(r.alias("text")).alias("shortDescription")))
    run = F.struct(F.struct(F.struct(F.lit("quarrylens").alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), F.col("results"))
    doc = F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs")))
    return grouped.select("source", "block", doc.alias("document"))
