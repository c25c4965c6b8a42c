"""Queries over the call graph. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens import dims
from quarrylens.operators import funnel, graph
from quarrylens.session import cut_lineage, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _resolved(policy: str) -> str:
    return f"""SELECT DISTINCT e.caller_id AS src, t.dst FROM (SELECT DISTINCT caller_id, callee_name FROM edges WHERE callee_name <> '') e
      JOIN (SELECT name, {policy}(id) AS dst FROM nodes WHERE name <> '' GROUP BY name) t ON t.name = e.callee_name WHERE e.caller_id <> t.dst"""


def _edges(spark: SparkSession, d: str, policy: str = "min") -> DataFrame:
    return graph.resolve(table(spark, d, "nodes"), table(spark, d, "edges"), {"min": "first", "max": "last"}[policy])


@query(_resolved("min"))
def edges_first(spark: SparkSession, d: str) -> DataFrame:
    """Calls resolved to the first function of the name."""
    return _edges(spark, d)


@query(_resolved("max"))
def edges_last(spark: SparkSession, d: str) -> DataFrame:
    """Calls resolved to the last function of the name."""
    return _edges(spark, d, "max")


@query("""
    SELECT DISTINCT e.caller_id AS src, n.id AS dst FROM edges e JOIN nodes c ON c.id = e.caller_id JOIN nodes n ON n.name = e.callee_name AND n.repo = c.repo WHERE n.id <> e.caller_id""")
def edges_in_repo(spark: SparkSession, d: str) -> DataFrame:
    """Calls resolved to all functions of the name in the caller's repository."""
    return graph.resolve_in_repo(table(spark, d, "nodes"), table(spark, d, "edges"))


@query("""
    SELECT DISTINCT c.id AS src, n.id AS dst FROM (SELECT id, repo, file, unnest(regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]*) *\\(', 1)) AS name FROM nodes WHERE code <> '') c
    JOIN nodes n ON n.name = c.name AND n.repo = c.repo AND n.file = c.file WHERE n.id <> c.id""")
def edges_from_code(spark: SparkSession, d: str) -> DataFrame:
    """Calls inside a file, read from the code: extracted names, then an equi-join on file and name."""
    from quarrylens.functions import text as T

    n = table(spark, d, "nodes")
    calls = n.where("code <> ''").select(F.col("id").alias("src"), "repo", "file", F.explode(F.array_distinct(T.called_names("code"))).alias("name"))
    return calls.join(n.select(F.col("id").alias("dst"), "repo", "file", "name"), ["repo", "file", "name"]).where("src <> dst").select("src", "dst").distinct()


@query("""
    SELECT callee_name, caller_id, name AS caller FROM (
      SELECT e.callee_name, e.caller_id, n.name, row_number() OVER (PARTITION BY e.callee_name ORDER BY e.caller_id) AS r
      FROM (SELECT DISTINCT caller_id, callee_name FROM edges WHERE callee_name <> '') e JOIN nodes n ON n.id = e.caller_id) WHERE r <= 30""")
def callers(spark: SparkSession, d: str) -> DataFrame:
    """Up to thirty callers of each name."""
    e = table(spark, d, "edges").where("callee_name <> ''").select("caller_id", "callee_name").distinct()
    named = e.join(table(spark, d, "nodes").select(F.col("id").alias("caller_id"), F.col("name").alias("caller")), "caller_id")
    return funnel.cap_per(named, ["callee_name"], [F.col("caller_id")], 30).select("callee_name", "caller_id", "caller")


@query("""
    SELECT caller_id, count(DISTINCT callee_name) AS callees, count(*) AS rows, min(callee_name) AS first_callee FROM edges WHERE callee_name <> '' GROUP BY 1""")
def callees(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").where("callee_name <> ''").groupBy("caller_id").agg(
        F.countDistinct("callee_name").alias("callees"), F.count(F.lit(1)).alias("rows"), F.min("callee_name").alias("first_callee")
    )


@query("""
    SELECT name, count(*) AS functions, count(DISTINCT repo) AS repos, min(id) AS first_id, max(id) AS last_id, count_if(coalesce(is_entry, false)) AS entries, count_if(coalesce(is_sink, false)) AS sinks
    FROM nodes WHERE name <> '' GROUP BY 1""")
def function_lookup(spark: SparkSession, d: str) -> DataFrame:
    """What a name can mean: functions, repositories, first and last, tags."""
    return table(spark, d, "nodes").where("name <> ''").groupBy("name").agg(
        F.count(F.lit(1)).alias("functions"), F.countDistinct("repo").alias("repos"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.count_if(F.coalesce("is_entry", F.lit(False))).alias("entries"), F.count_if(F.coalesce("is_sink", F.lit(False))).alias("sinks"),
    )


def _owner_sql(order: str) -> str:
    return f"""
    SELECT vuln_id, node_id FROM (
      SELECT v.vuln_id, n.id AS node_id, row_number() OVER (PARTITION BY v.vuln_id ORDER BY n.start_line {order}, n.id) AS r
      FROM vulns v JOIN registry g ON g.id = v.candidate_id JOIN nodes n ON n.repo = g.package AND n.file = replace(v.affected_file, chr(92), '/') AND v.affected_line BETWEEN n.start_line AND n.end_line) WHERE r = 1"""


def _owned(spark: SparkSession, d: str, keep: str) -> DataFrame:
    repos = table(spark, d, "registry").select(F.col("id").alias("candidate_id"), F.col("package").alias("repo"))
    points = table(spark, d, "vulns").where("affected_line is not null and affected_file is not null").join(repos, "candidate_id").select(
        F.col("vuln_id").alias("point_id"), "repo", F.regexp_replace("affected_file", "\\\\", "/").alias("file"), "affected_line"
    )
    spans = table(spark, d, "nodes").where("start_line is not null and end_line is not null").select(F.col("id").alias("span_id"), "repo", "file", "start_line", "end_line")
    return graph.owners(points, spans, ["repo", "file"], "affected_line", "start_line", "end_line", keep).select(
        F.col("point_id").alias("vuln_id"), F.col("span_id").alias("node_id")
    )


@query(_owner_sql("DESC"))
def line_owner_inner(spark: SparkSession, d: str) -> DataFrame:
    """Innermost function that holds the line of a finding."""
    return _owned(spark, d, "innermost")


@query(_owner_sql("ASC"))
def line_owner_outer(spark: SparkSession, d: str) -> DataFrame:
    """Outermost function that holds the line of a finding."""
    return _owned(spark, d, "outermost")


_ENTRY = "SELECT id FROM nodes WHERE is_entry"
_SINK = "SELECT id FROM nodes WHERE is_sink"


def _paths_list_sql(most: int, stop: bool) -> str:
    """Every simple path as a list of ids, by recursion."""
    halt = f"AND (len(p.path) = 1 OR p.node NOT IN ({_SINK}))" if stop else ""
    return f"""WITH RECURSIVE e AS ({_resolved('min')}),
    p AS (SELECT id AS entry, id AS node, [id] AS path, 1 AS depth FROM ({_ENTRY})
      UNION ALL SELECT p.entry, e.dst, list_append(p.path, e.dst), p.depth + 1 FROM p JOIN e ON e.src = p.node
      WHERE p.depth < {most} AND NOT list_contains(p.path, e.dst) {halt})
    SELECT entry, node AS sink, depth, path AS ids FROM p WHERE depth > 1 AND node IN ({_SINK})"""


def _paths_sql(most: int, stop: bool) -> str:
    return f"SELECT *, array_to_string(ids, '>') AS path FROM ({_paths_list_sql(most, stop)})"


def _ends(spark: SparkSession, d: str):
    n = table(spark, d, "nodes")
    return n.where("is_entry").select("id"), n.where("is_sink").select("id")


def _paths(spark: SparkSession, d: str, **options) -> DataFrame:
    return graph.paths(cut_lineage(_edges(spark, d)), *_ends(spark, d), **options)


@query(f"""SELECT entry, sink, depth::INT AS depth, path FROM (
      SELECT *, row_number() OVER (PARTITION BY entry, sink ORDER BY depth, ids) AS r FROM ({_paths_sql(5, False)})) WHERE r = 1""")
def paths_shortest(spark: SparkSession, d: str) -> DataFrame:
    """Shortest path of each entry and sink, through sinks, of at most five nodes."""
    return _paths(spark, d, max_nodes=5)


@query(f"""SELECT entry, sink, depth::INT AS depth, path FROM (
      SELECT *, row_number() OVER (PARTITION BY entry, sink ORDER BY depth, ids) AS r FROM ({_paths_sql(6, True)})) WHERE r = 1""")
def paths_to_first_sink(spark: SparkSession, d: str) -> DataFrame:
    """Shortest path of each entry and sink that passes no other sink."""
    return _paths(spark, d, max_nodes=6, stop_at_sink=True)


@query()
def paths_to_first_sink_full(spark: SparkSession, d: str) -> DataFrame:
    """paths_to_first_sink to the reference's bound of nine nodes. SQL would list every path, so it has none."""
    return _paths(spark, d, max_nodes=9, stop_at_sink=True, ahead=True)


_UNTESTED = "regexp_matches(lower(coalesce(file, '')), '(^|/)(tests?|spec|conftest)(/|_|\\.)|_test\\.|/test_') OR starts_with(coalesce(name, ''), 'test_') OR ends_with(coalesce(name, ''), '_test')"


@query(f"""SELECT entry, sink, depth::INT AS depth, path FROM (
      SELECT *, row_number() OVER (PARTITION BY entry, sink ORDER BY depth, ids) AS r FROM ({_paths_sql(6, True)})) WHERE r = 1 AND entry NOT IN (SELECT id FROM nodes WHERE {_UNTESTED})""")
def paths_from_untested(spark: SparkSession, d: str) -> DataFrame:
    """paths_to_first_sink from entries that are no tests."""
    n = table(spark, d, "nodes")
    tests = F.lower(F.coalesce("file", F.lit(""))).rlike("(^|/)(tests?|spec|conftest)(/|_|\\.)|_test\\.|/test_") | F.coalesce("name", F.lit("")).startswith("test_") | F.coalesce("name", F.lit("")).endswith("_test")
    return graph.paths(cut_lineage(_edges(spark, d)), n.where(F.col("is_entry") & ~tests).select("id"), _ends(spark, d)[1], max_nodes=6, stop_at_sink=True)


@query("""
    SELECT caller_id, callee_name, r::INT AS place FROM (SELECT caller_id, callee_name, row_number() OVER (PARTITION BY caller_id ORDER BY callee_name) AS r
      FROM (SELECT DISTINCT caller_id, callee_name FROM edges WHERE callee_name <> '')) WHERE r <= 50""")
def callee_rows(spark: SparkSession, d: str) -> DataFrame:
    """Up to fifty distinct callees of each function."""
    e = table(spark, d, "edges").where("callee_name <> ''").select("caller_id", "callee_name").distinct()
    return e.withColumn("place", F.row_number().over(W.partitionBy("caller_id").orderBy("callee_name"))).where("place <= 50")


@query("""
    SELECT name, id, repo, file, tags FROM (SELECT name, id, repo, file, concat_ws(',', CASE WHEN is_entry THEN 'entry' END, CASE WHEN is_gate THEN 'gate' END, CASE WHEN is_sink THEN 'sink' END) AS tags,
      row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM nodes WHERE name <> '') WHERE r <= 5""")
def function_rows(spark: SparkSession, d: str) -> DataFrame:
    """Up to five functions of each name with their tags."""
    n = table(spark, d, "nodes").where("name <> ''")
    tags = F.concat_ws(",", *(F.when(F.col(f"is_{t}"), t) for t in ("entry", "gate", "sink")))
    return funnel.cap_per(n.select("name", "id", "repo", "file", tags.alias("tags")), ["name"], [F.col("id")], 5)


_PATH_PARTS = f"""p AS (SELECT entry, sink, ids, path FROM (SELECT *, row_number() OVER (PARTITION BY entry, sink ORDER BY depth, ids) AS r FROM ({_paths_sql(5, False)})) WHERE r = 1),
    m AS (SELECT entry, sink, path, ids, unnest(range(1, len(ids) + 1)) AS k FROM p),
    h AS (SELECT m.entry, m.sink, m.path, m.k, length(coalesce(n.name, '') || coalesce(n.file, '')) + 40 AS head, length(coalesce(n.code, '')) AS size FROM m JOIN nodes n ON n.id = m.ids[m.k]),
    s AS (SELECT *, coalesce(sum(head + size) OVER (PARTITION BY entry, sink ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h)"""


@query(f"""WITH {_PATH_PARTS}
    SELECT entry, sink, path, count(*) AS parts, sum(least(size, 8000 - used - head))::BIGINT AS code_chars FROM s WHERE used + head + 200 <= 8000 GROUP BY 1, 2, 3""")
def path_prompts(spark: SparkSession, d: str) -> DataFrame:
    """How much code of a path's functions, in order, fits a prompt of 8,000 characters: a part needs its header and 200 more, the last one is cut."""
    found = _paths(spark, d, max_nodes=5)
    m = found.select("entry", "sink", "path", F.posexplode(F.split("path", ">")).alias("k", "node"))
    n = table(spark, d, "nodes").select(
        F.col("id").alias("node"), (F.length(F.concat(F.coalesce("name", F.lit("")), F.coalesce("file", F.lit("")))) + 40).alias("head"), F.length(F.coalesce("code", F.lit(""))).alias("size")
    )
    before = W.partitionBy("entry", "sink").orderBy("k").rowsBetween(W.unboundedPreceding, -1)  # at most five rows
    s = m.withColumn("node", F.col("node").cast("long")).join(n, "node").withColumn("used", F.coalesce(F.sum(F.col("head") + F.col("size")).over(before), F.lit(0)))
    return s.where("used + head + 200 <= 8000").groupBy("entry", "sink", "path").agg(
        F.count(F.lit(1)).alias("parts"), F.sum(F.least("size", 8000 - F.col("used") - F.col("head"))).cast("long").alias("code_chars")
    )


@query(f"SELECT entry, sink, depth::INT AS depth, path FROM ({_paths_sql(6, False)})")
def paths_all(spark: SparkSession, d: str) -> DataFrame:
    """All simple paths from entries to sinks, through sinks."""
    return _paths(spark, d, max_nodes=6, keep="all")


_GUARD = f"regexp_matches(lower(callee_name), '{dims.GUARD_STEMS}')"
_PATHS = f"paths AS MATERIALIZED (SELECT DISTINCT entry, sink, path FROM ({_paths_sql(5, False)}))"
_GUARDS = f"""guards AS (SELECT DISTINCT m.path, e.callee_name AS guard FROM (SELECT path, unnest(string_split(path, '>'))::BIGINT AS node FROM (SELECT DISTINCT path FROM paths)) m
      JOIN edges e ON e.caller_id = m.node WHERE {_GUARD})"""


def _is_guard() -> Column:
    return F.lower("callee_name").rlike(dims.GUARD_STEMS)


def _with_guards(spark: SparkSession, d: str, **options):
    found = cut_lineage(_paths(spark, d, **({"max_nodes": 5, "keep": "all"} | options)).select("entry", "sink", "path").distinct())
    guards = graph.guards_of(found, table(spark, d, "edges"), _is_guard())
    return found, cut_lineage(guards)


#: The reference's bound for comparisons: ten calls, eleven nodes.
_FULL = {"max_nodes": 11, "keep": "all", "ahead": True}


def _halves(spark: SparkSession, d: str, carried: DataFrame, empty: Column, merge: graph.Merge) -> graph.Halves:
    return graph.halves(cut_lineage(_edges(spark, d)), *_ends(spark, d), max_nodes=_FULL["max_nodes"], carried=carried, empty=empty, merge=merge)


def _guarded_halves(spark: SparkSession, d: str) -> graph.Halves:
    called = table(spark, d, "edges").where(_is_guard()).groupBy(F.col("caller_id").alias("node")).agg(F.collect_set("callee_name").alias("own"))
    return _halves(spark, d, called, F.array().cast("array<string>"), F.array_union)


@query()
def paths_all_full(spark: SparkSession, d: str) -> DataFrame:
    """paths_all to eleven nodes."""
    return _paths(spark, d, **_FULL)


def _names(guards: DataFrame) -> DataFrame:
    return guards.groupBy("path").agg(F.count(F.lit(1)).alias("guards"), F.array_join(F.array_sort(F.collect_set("guard")), ",").alias("names"))


@query(f"WITH {_PATHS}, {_GUARDS} SELECT path, count(DISTINCT guard) AS guards, string_agg(DISTINCT guard, ',' ORDER BY guard) AS names FROM guards GROUP BY 1")
def path_guards(spark: SparkSession, d: str) -> DataFrame:
    """Guards called by any node of each path."""
    return _names(_with_guards(spark, d)[1])


@query()
def path_guards_full(spark: SparkSession, d: str) -> DataFrame:
    """path_guards to eleven nodes. Each half carries the guards of its nodes."""
    h = _guarded_halves(spark, d)
    bare = h._replace(merge=None)  # their own lists stay apart: only paths that have guards in both halves need a union
    long = graph.pairs(bare).where("size(own) > 0 or size(own_after) > 0").withColumn("own", F.when(F.size("own_after") == 0, F.col("own")).otherwise(F.array_union("own", "own_after")))
    found = long.select("path", "own").unionByName(h.whole.where("size(own) > 0").select(graph.path_text(h.before).alias("path"), "own"))
    return found.select("path", F.size("own").cast("long").alias("guards"), F.array_join(F.sort_array("own"), ",").alias("names"))


@query(f"""WITH {_PATHS}, {_GUARDS},
    wanted AS (SELECT DISTINCT p.sink, g.guard FROM paths p JOIN guards g USING (path)),
    several AS (SELECT sink FROM paths GROUP BY 1 HAVING count(*) > 1),
    missing AS (SELECT p.entry, p.sink, p.path, w.guard FROM paths p JOIN several USING (sink) JOIN wanted w USING (sink)
      WHERE NOT EXISTS (SELECT 1 FROM guards g WHERE g.path = p.path AND g.guard = w.guard)),
    n AS (SELECT sink, count(*) AS n_all FROM wanted GROUP BY 1),
    f AS (SELECT p.sink, g.guard, min(p.path) AS holder FROM paths p JOIN guards g USING (path) GROUP BY 1, 2)
    SELECT entry, sink, path, string_agg(guard, ',' ORDER BY guard) AS missing, count(*)::DOUBLE / any_value(n_all) AS score, min(holder) AS sibling
    FROM missing JOIN n USING (sink) JOIN f USING (sink, guard) GROUP BY 1, 2, 3""")
def compare_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Paths without a guard that another path to the same sink has."""
    return graph.compare_siblings(*_with_guards(spark, d))


@query()
def compare_siblings_full(spark: SparkSession, d: str) -> DataFrame:
    """compare_siblings to eleven nodes. Halves carry the numbers of guards."""
    called = table(spark, d, "edges").where(_is_guard()).select(F.col("caller_id").alias("node"), F.col("callee_name").alias("name")).distinct()
    names = graph.numbered(called.select("name"))
    numbers = called.join(names, "name").groupBy("node").agg(F.collect_set("number").alias("own"))
    return graph.siblings_of_halves(_halves(spark, d, numbers, F.array().cast("array<int>"), F.array_union), names=names)


def _verdicts(spark: SparkSession, d: str, found: DataFrame, guards: DataFrame) -> DataFrame:
    gates = table(spark, d, "nodes").where("is_gate").select(F.col("id").alias("node"))
    member = graph.path_nodes(found).join(gates, "node", "left_semi").select("path").distinct().withColumn("member", F.lit(True))
    called = guards.select("path").distinct().withColumn("called", F.lit(True))
    verdict = F.when(F.col("member"), "gate on the path").when(F.col("called"), "guard called").otherwise("survives")
    return found.join(member, "path", "left").join(called, "path", "left").select("entry", "sink", "path", verdict.alias("verdict"))


@query(f"""WITH {_PATHS}, {_GUARDS},
    member AS (SELECT DISTINCT path FROM (SELECT path, unnest(string_split(path, '>'))::BIGINT AS node FROM paths) m JOIN nodes n ON n.id = m.node WHERE n.is_gate)
    SELECT entry, sink, path, CASE WHEN path IN (SELECT path FROM member) THEN 'gate on the path' WHEN path IN (SELECT path FROM guards) THEN 'guard called' ELSE 'survives' END AS verdict FROM paths""")
def rebut_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths rejected because a gate lies on them or a guard is called beside them; the others survive."""
    return _verdicts(spark, d, *_with_guards(spark, d))


@query()
def rebut_paths_full(spark: SparkSession, d: str) -> DataFrame:
    """rebut_paths to eleven nodes. Each half carries the strongest objection of its nodes, so no path meets a table."""
    gates = table(spark, d, "nodes").where("is_gate").select(F.col("id").alias("node"), F.lit(2).alias("own"))
    callers = table(spark, d, "edges").where(_is_guard()).select(F.col("caller_id").alias("node"), F.lit(1).alias("own"))
    found = graph.all_paths(_halves(spark, d, gates.unionByName(callers).groupBy("node").agg(F.max("own").alias("own")), F.lit(0), F.greatest))
    verdict = F.when(F.col("own") == 2, "gate on the path").when(F.col("own") == 1, "guard called").otherwise("survives")
    return found.select("entry", "sink", "path", verdict.alias("verdict"))


@query(f"""WITH p AS ({_paths_sql(5, False)})
    SELECT kind, sink, path FROM (SELECT coalesce(nullif(n.sink_kind, ''), 'none') AS kind, p.sink, p.path,
      row_number() OVER (PARTITION BY coalesce(nullif(n.sink_kind, ''), 'none') ORDER BY p.depth, p.path, p.sink) AS r FROM p JOIN nodes n ON n.id = p.sink) WHERE r = 1""")
def representative_paths(spark: SparkSession, d: str) -> DataFrame:
    """The shortest path to each kind of sink."""
    kind = F.coalesce(F.nullif(F.col("sink_kind"), F.lit("")), F.lit("none")).alias("kind")
    found = _paths(spark, d, max_nodes=5).join(table(spark, d, "nodes").select(F.col("id").alias("sink"), kind), "sink")
    best = F.min_by(F.struct("sink", "path"), F.struct("depth", "path", "sink")).alias("b")
    return found.groupBy("kind").agg(best).select("kind", "b.sink", "b.path")


@query("""
    SELECT file, name, origin, id FROM (
      SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY priority, id) AS r FROM (
        SELECT file, name, 'entry' AS origin, 0 AS priority, id FROM nodes WHERE is_entry AND file IS NOT NULL AND name <> ''
        UNION ALL SELECT file, name, 'sink', 1, id FROM nodes WHERE is_sink AND file IS NOT NULL AND name <> ''
        UNION ALL SELECT file_path, name, 'second scan', 2, func_id FROM func_nodes WHERE file_path IS NOT NULL AND name <> '')) WHERE r = 1""")
def merge_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of several origins, the most important origin winning for a function."""
    n, f = table(spark, d, "nodes").where("file is not null and name <> ''"), table(spark, d, "func_nodes").where("file_path is not null and name <> ''")
    parts = [
        n.where("is_entry").select("file", "name", "id", F.lit("entry").alias("origin")),
        n.where("is_sink").select("file", "name", "id", F.lit("sink").alias("origin")),
        f.select(F.col("file_path").alias("file"), "name", F.col("func_id").alias("id"), F.lit("second scan").alias("origin")),
    ]
    return funnel.first_wins(parts, ["file", "name"]).select("file", "name", "origin", "id")
