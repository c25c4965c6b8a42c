"""Queries on Python syntax trees: SQL can't parse code, so tests compare them with small fixtures and with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import syntax
from quarrylens.functions import text as T
from quarrylens.operators import chunks
from quarrylens.session import table

ORACLE: dict = {}


def _python(spark: SparkSession, d: str) -> DataFrame:
    return syntax.python_functions(table(spark, d, "nodes").where("file like '%.py'"), "id", "code")


def ast_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions of each row's code with what they call and whether they decide something."""
    return _python(spark, d).where("error is null").select(
        "id", "name", "kind", "start_line", "end_line", F.array_join("calls", ",").alias("calls"), "decides", "parses", "intent"
    )


def ast_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose code doesn't parse."""
    return _python(spark, d).where("error is not null").select("id", "error")


def ast_calls(spark: SparkSession, d: str) -> DataFrame:
    """Called names with their owners, from the syntax tree."""
    calls = _python(spark, d).where("error is null").select("id", F.explode("dotted").alias("dotted")).distinct()
    return calls.select("id", "dotted", F.regexp_extract("dotted", "([^.]*)$", 1).alias("callee"))


def ast_intent(spark: SparkSession, d: str) -> DataFrame:
    """Functions of security intent with the additive score of their signs."""
    return _python(spark, d).where("intent").select("id", "name", "score", "tells", "documented", "takes_input", "decides", "parses")


def ast_entries(spark: SparkSession, d: str) -> DataFrame:
    """Decorators and parameters of functions, from the tree."""
    return _python(spark, d).where("error is null").select("id", "name", F.array_join("decorators", ",").alias("decorators"), F.array_join("parameters", ",").alias("parameters"))


def ast_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Function chunks with imports and class header; methods also as functions."""
    return syntax.chunks(_python(spark, d), twice=True).select("id", "name", "kind", "start_line", "end_line", "context")


def routed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by size and language: functions of Python that parses, line windows of everything else and of very large texts."""
    n = table(spark, d, "nodes").where("code <> ''")
    small = F.length("code") <= syntax.LARGE
    trees = syntax.python_functions(n.where(small & F.lower("file").endswith(".py")), "id", "code")
    functions = syntax.chunks(trees).select("id", F.lit("function").alias("origin"), "start_line", "end_line")
    broken = trees.where("error is not null").select("id")
    rest = n.where(~small | ~F.coalesce(F.lower("file").endswith(".py"), F.lit(False))).unionByName(n.join(broken, "id", "left_semi"))
    windows = chunks.line_windows(rest, "id", "code", *syntax.WINDOW).select("id", F.lit("window").alias("origin"), "start_line", "end_line")
    return functions.unionByName(windows)


def file_classes(spark: SparkSession, d: str) -> DataFrame:
    """Lines, functions and classes of each Python file, over all its rows."""
    f = _python(spark, d).groupBy("id").agg(F.count("name").alias("functions"), F.countDistinct("owner").alias("classes"))
    n = table(spark, d, "nodes").where("file like '%.py' and code <> ''").select("id", "repo", "file", F.size(T.lines("code")).alias("lines"))
    return n.join(f, "id", "left").groupBy("repo", "file").agg(
        F.sum("lines").alias("lines"), F.sum(F.coalesce("functions", F.lit(0))).alias("functions"), F.sum(F.coalesce("classes", F.lit(0))).alias("classes")
    )


def script_vetting(spark: SparkSession, d: str) -> DataFrame:
    """Proof scripts that import process or network modules or don't parse, and whether they import the package they are about."""
    v = table(spark, d, "vulns").where("poc_code <> ''")
    package = table(spark, d, "registry").select(F.col("id").alias("candidate_id"), F.lower(F.translate("package", "-", "_")).alias("package"))
    about = v.select("vuln_id", "candidate_id").join(package, "candidate_id", "left").select("vuln_id", "package")
    roots = F.transform("imports", lambda m: F.lower(F.split(m, "\\.")[0]))
    scripts = syntax.vetted(syntax.python_scripts(v, "vuln_id", "poc_code"), syntax.BLOCKED).join(about, "vuln_id")
    return scripts.select("vuln_id", "blocked", "functions", F.coalesce(F.array_contains(roots, F.col("package")), F.lit(False)).alias("imports_target"))


QUERIES = {
    f.__name__: f
    for f in (ast_functions, ast_quarantine, ast_calls, ast_intent, ast_entries, ast_chunks, routed_chunks, file_classes, script_vetting)
}
