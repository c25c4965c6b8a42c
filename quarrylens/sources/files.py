"""Reading source trees, line-delimited JSON and logs; writing stage outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens import dims
from quarrylens.functions import text as T


def source_files(spark: SparkSession, root: str, most_bytes: int = 300_000, skip: list[str] = dims.SKIP_DIRS, extensions: list[str] | None = None) -> DataFrame:
    """path, language, text of source files below a root, without skipped and ``*.egg-info`` directories. Size and path are tested before any content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    outside = ~F.arrays_overlap(parts, F.array(*(F.lit(x) for x in skip))) & ~F.exists(parts, lambda x: x.endswith(".egg-info"))
    kept = listed.where((F.col("length") <= most_bytes) & T.extension("path").isin(*(extensions or dims.LANGUAGES)) & outside)
    return kept.select("path", T.language("path").alias("language"), F.decode("content", "UTF-8").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined lines of a line-delimited JSON file; ``strict`` raises on the first bad line."""
    if strict:
        good = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        return good, spark.createDataFrame([], "value string")
    raw = spark.read.text(path).where("trim(value) <> ''")
    parsed = raw.withColumn("row", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = parsed.where("row._corrupt is null").select("row.*").drop("_corrupt")
    return good, parsed.where("row._corrupt is not null").select("value")


def write_split(df: DataFrame, passes, folder: str) -> None:
    """Survivors and rejected rows as two stage outputs; together they are the input."""
    keep = F.coalesce(passes, F.lit(False))
    df.where(keep).write.mode("overwrite").json(f"{folder}/survivors")
    df.where(~keep).write.mode("overwrite").json(f"{folder}/rejected")


def append_rows(df: DataFrame, folder: str) -> None:
    """Adds rows to a stored list; earlier rows stay as they are."""
    df.write.mode("append").json(folder)


def last_rows(spark: SparkSession, folder: str, schema: str, order: str, most: int = 20) -> DataFrame:
    """The last rows of a stored list by a column; lines that don't parse are passed over."""
    good, _ = json_lines(spark, folder, schema)
    return good.orderBy(F.col(order).desc()).limit(most)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and distinct calls in place of what was stored."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.where("callee_name <> ''").select("caller_id", "callee_name").distinct().write.mode("overwrite").parquet(f"{folder}/edges")


# Columns that operators read, by table.
CONTRACTS = {
    "nodes": "id long, repo string, name string, file string, start_line int, end_line int, code string, is_entry boolean, is_gate boolean, is_sink boolean, sink_kind string",
    "edges": "caller_id long, callee_name string",
    "vulns": "vuln_id long, candidate_id string, source string, vuln_type string, confidence double, affected_file string, affected_line int, description string, root_cause string, poc_code string",
    "da_results": "da_id long, vuln_id long, source string, da_survived boolean, rebuttal string, final_confidence double",
    "poc_results": "run_id long, vuln_id long, source string, executed boolean, vulnerable boolean, stdout string, exit_code int",
    "registry": "id string, package string, github_url string, ecosystem string, status string",
}


def conforming(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table's contract in its types; raises where one is missing."""
    wanted = [c.strip().split(" ") for c in CONTRACTS[name].split(",")]
    missing = [c for c, _ in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in wanted))
