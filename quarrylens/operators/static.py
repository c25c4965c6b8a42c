"""Static scan over code rows: calls and patterns by line, sinks near input, entries, blocks, imports.

Lines stay in their row as an array until something is found in them; what leaves a row is a hit with that array, so that the lines
around it can still be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions import text as T


def literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def around(lines: str, line: str, n: int) -> Column:
    """The text of ``n`` lines before and behind a line (counted from 1), and that line."""
    first = F.greatest(F.col(line) - n, F.lit(1)).cast("int")
    return F.array_join(F.slice(F.col(lines), first, (F.col(line) + n - first + 1).cast("int")), "\n")


def line_calls(df: DataFrame, id_col: str, code: str) -> DataFrame:
    """id, code, ls, line, called: distinct dotted names in front of a parenthesis, by line."""
    pattern = F.lit("([A-Za-z_][A-Za-z0-9_.]*) *\\(")
    found = F.flatten(F.transform("ls", lambda x, i: F.transform(
        F.array_distinct(F.regexp_extract_all(x, pattern, F.lit(1))), lambda c: F.struct((i + 1).alias("line"), c.alias("called"))
    )))
    rows = df.select(id_col, F.col(code).alias("code"), T.lines(code).alias("ls")).withColumn("c", F.explode(found))
    return rows.select(id_col, "code", "ls", "c.line", "c.called")


def match_sinks(calls: DataFrame, sinks: dict[str, list[str]]) -> DataFrame:
    """vuln_type and sink_name of calls: by their last name, and for dotted sinks by an owner that is or ends like theirs; the first sink of a type counts.

    The sinks of a last name are an array found by a map, so calls need no join.
    """
    by_method: dict[str, list[tuple[str, int, str, str, str]]] = {}
    for kind, names in sinks.items():
        for pos, name in enumerate(names):
            obj, _, method = name.rpartition(".")
            by_method.setdefault(method, []).append((kind, pos, name, obj, obj.rpartition(".")[2]))
    entry = lambda e: F.struct(*(F.lit(v).alias(n) for n, v in zip(("vuln_type", "pos", "sink", "obj", "tail"), e)))
    table = F.map_from_arrays(literals(by_method), F.array(*(F.array(*map(entry, es)) for es in by_method.values())))
    split = calls.select(
        "*", F.regexp_extract("called", "([^.]*)$", 1).alias("method"), F.regexp_extract("called", "^(.*)\\.", 1).alias("owner")
    ).where(F.col("method").isin(*by_method))
    fits = F.filter(table[F.col("method")], lambda e: (e.obj == "") | F.col("called").contains(".") & ((F.col("owner") == e.obj) | F.col("owner").endswith(e.tail)))
    best = F.filter("fits", lambda e: ~F.exists("fits", lambda o: (o.vuln_type == e.vuln_type) & (o.pos < e.pos)))
    hit = split.withColumn("fits", fits).where("size(fits) > 0").withColumn("s", F.explode(best))
    return hit.drop("fits", "method", "owner").withColumns({"vuln_type": F.col("s.vuln_type"), "sink_name": F.col("s.sink")}).drop("s")


def pattern_hits(df: DataFrame, id_col: str, code: str, patterns: dict[str, list[str]]) -> DataFrame:
    """id, ls, line, vuln_type, match: every match of every pattern, by line."""
    wanted = [(kind, p) for kind, ps in patterns.items() for p in ps]
    any_of = "|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for _, p in wanted)

    def hits_of(kind: str, p: str, x: Column, i: Column) -> Column:
        return F.transform(F.regexp_extract_all(x, F.lit(p), F.lit(0)), lambda m: F.struct((i + 1).alias("line"), F.lit(kind).alias("vuln_type"), m.alias("match")))

    def per_line(x: Column, i: Column) -> Column:
        return F.flatten(F.array(*(hits_of(kind, p, x, i) for kind, p in wanted)))

    lines = df.where(F.col(code).rlike(any_of)).select(id_col, T.lines(code).alias("ls"))
    hit_lines = F.filter(F.transform("ls", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s.x.rlike(any_of))
    hits = lines.withColumn("h", F.explode(F.flatten(F.transform(hit_lines, lambda s: per_line(s.x, s.i)))))
    return hits.select(id_col, "ls", "h.line", "h.vuln_type", "h.match")


def decorators(code: str) -> Column:
    """Last names of decorators, in lower case."""
    found = F.regexp_extract_all(code, F.lit("(?m)^[ \\t]*@(?:[A-Za-z_][A-Za-z0-9_]*\\.)*([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    return F.transform(found, lambda x: F.lower(x))


def parameters(code: str) -> Column:
    """Names of the parameters of the first function."""
    inside = F.regexp_extract(code, "def +[A-Za-z_][A-Za-z0-9_]* *\\(([^)]*)\\)", 1)
    return F.transform(F.split(inside, ",", -1), lambda x: F.regexp_extract(F.trim(x), "^([A-Za-z_][A-Za-z0-9_]*)", 1))


def brace_functions(df: DataFrame, id_col: str, code: str, pattern: str, most: int = 60) -> DataFrame:
    """id, name, start_line, end_line, block: functions by the first line that matches, up to where their braces are closed again."""
    opened = lambda x: F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit("")))
    closed = lambda x: F.length(x) - F.length(F.replace(x, F.lit("}"), F.lit("")))
    starts = F.filter(F.transform("ls", lambda x, i: F.when(x.rlike(pattern), i + 1)), lambda v: v.isNotNull())
    rows = df.where(F.col(code).rlike(pattern)).select(id_col, T.lines(code).alias("ls")).withColumn("start_line", F.explode(starts))
    state = F.aggregate(
        F.slice("ls", F.col("start_line"), most),
        F.struct(F.lit(0).alias("depth"), F.lit(False).alias("begun"), F.lit(0).alias("n"), F.lit(False).alias("done")),
        lambda s, x: F.when(s.done, s).otherwise(F.struct(
            (s.depth + opened(x) - closed(x)).alias("depth"), (s.begun | (opened(x) > 0)).alias("begun"), (s.n + 1).alias("n"),
            ((s.begun | (opened(x) > 0)) & (s.depth + opened(x) - closed(x) <= 0)).alias("done"),
        )),
    )
    line = F.element_at("ls", F.col("start_line"))
    name = F.coalesce(*(F.nullif(F.regexp_extract(line, pattern, k), F.lit("")) for k in (1, 2, 3)), F.lit("anon"))
    return rows.withColumn("n", state.n).select(
        id_col, name.alias("name"), "start_line", (F.col("start_line") + F.col("n") - 1).alias("end_line"),
        F.array_join(F.slice("ls", F.col("start_line"), F.col("n")), "\n").alias("block"),
    )


def imports(nodes: DataFrame) -> DataFrame:
    """repo, file, module: distinct imports of Python files and local ones of scripts."""
    code = nodes.where("code <> ''")
    python = F.concat(
        F.regexp_extract_all("code", F.lit("(?m)^[ \\t]*from[ \\t]+([A-Za-z0-9_.]+)[ \\t]+import"), F.lit(1)),
        F.regexp_extract_all("code", F.lit("(?m)^[ \\t]*import[ \\t]+([A-Za-z0-9_.]+)"), F.lit(1)),
    )
    script = F.regexp_extract_all("code", F.lit("(?:import|require)[ \\t]*[ (]['\"]([./][^'\"]+)['\"]"), F.lit(1))
    found = F.when(F.lower("file").endswith(".py"), python).when(T.is_script("file"), script)
    return code.select("repo", "file", F.explode(F.array_distinct(found)).alias("module")).where("module <> ''").distinct()


def neighbours(nodes: DataFrame, priority: list[str], most: int) -> DataFrame:
    """repo, target, caller, rank: files whose importing code names another file of their repository."""
    stem = F.regexp_extract("file", "([^/]*?)(?:\\.[A-Za-z]+)?$", 1)
    files = nodes.where("file is not null and repo is not null").select("repo", F.col("file").alias("target"), stem.alias("word")).distinct()
    words = nodes.where((F.col("code") != "") & F.col("code").rlike("import|require")).select(
        "repo", "file", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("word")
    )
    met = words.join(files, ["repo", "word"]).where("file <> target").select("repo", "target", "file").distinct()
    first = F.when(F.lower(stem).rlike("|".join(priority)), 0).otherwise(1)
    rank = F.row_number().over(W.partitionBy("repo", "target").orderBy(first, "file"))
    return met.withColumn("rank", rank).where(F.col("rank") <= most).select("repo", "target", F.col("file").alias("caller"), "rank")


def prompt() -> Column:
    """Class, description and script of a finding, the last two capped."""
    return F.concat_ws(
        "\n", F.concat(F.lit("## "), F.coalesce("vuln_type", F.lit("unknown"))), F.substring(F.coalesce("description", F.lit("")), 1, 600),
        F.substring(F.coalesce("poc_code", F.lit("")), 1, 3000),
    )
