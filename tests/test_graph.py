"""The four path policies on a small graph with a cycle and a diamond, and what follows from paths."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylens import dims
from quarrylens.operators import funnel, graph
from quarrylens.plans import graph_queries
from quarrylens.session import ensure_checkpoint_dir, table

NAMES = {1: "handle_a", 2: "handle_b", 3: "helper", 4: "check_permission", 5: "run_query", 6: "write_log", 7: "loop_x", 8: "alt"}
CALLS = [(1, 3), (1, 4), (2, 3), (2, 8), (3, 5), (8, 5), (5, 6), (3, 7), (7, 3)]


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([(i, n, i in (1, 2), i == 4, i in (5, 6)) for i, n in NAMES.items()], "id long, name string, is_entry boolean, is_gate boolean, is_sink boolean")
    edges = spark.createDataFrame([(a, NAMES[b]) for a, b in CALLS] + [(1, NAMES[3]), (3, ""), (3, "nowhere")], "caller_id long, callee_name string")
    return nodes, edges, graph.resolve(nodes, edges)


def named(df):
    return sorted(">".join(NAMES[int(x)] for x in r.path.split(">")) for r in df.collect())


def ends(g):
    return g[0].where("is_entry"), g[0].where("is_sink")


def test_shortest_through_sinks(g):
    got = graph.paths(g[2], *ends(g), max_nodes=5)
    assert named(got) == [
        "handle_a>helper>run_query", "handle_a>helper>run_query>write_log", "handle_b>alt>run_query", "handle_b>alt>run_query>write_log",
    ] or named(got) == [
        "handle_a>helper>run_query", "handle_a>helper>run_query>write_log", "handle_b>helper>run_query", "handle_b>helper>run_query>write_log",
    ]
    assert got.groupBy("entry", "sink").count().where("count > 1").isEmpty()


def test_stops_at_sink(g):
    got = graph.paths(g[2], *ends(g), max_nodes=8, stop_at_sink=True, keep="all")
    assert named(got) == ["handle_a>helper>run_query", "handle_b>alt>run_query", "handle_b>helper>run_query"]


def test_all_simple_paths(g):
    got = graph.paths(g[2], *ends(g), max_nodes=10, keep="all")
    assert len(named(got)) == 6
    assert all(len(set(p.split(">"))) == len(p.split(">")) for p in named(got))


def test_siblings_and_rebuttal(g, spark):
    found = graph.paths(g[2], *ends(g), max_nodes=10, keep="all").select("entry", "sink", "path")
    guards = graph.guards_of(found, g[1], F.col("callee_name") == "check_permission")
    missing = graph.compare_siblings(found, guards).collect()
    assert len(missing) == 4 and {r.entry for r in missing} == {2} and {r.score for r in missing} == {1.0}
    assert {r.missing for r in missing} == {"check_permission"}


def test_no_entry_gives_no_path(g, spark):
    none = g[0].where("false")
    assert graph.paths(g[2], none, g[0].where("is_sink")).isEmpty()


def test_owner_inner_and_outer(spark):
    spans = spark.createDataFrame([(1, "f", 1, 9), (2, "f", 5, 7), (3, "g", 1, 9)], "span_id long, file string, s int, e int")
    points = spark.createDataFrame([(10, "f", 6), (11, "f", 8), (12, "h", 1)], "point_id long, file string, line int")
    inner = {r.point_id: r.span_id for r in graph.owners(points, spans, "file", "line", "s", "e").collect()}
    outer = {r.point_id: r.span_id for r in graph.owners(points, spans, "file", "line", "s", "e", "outermost").collect()}
    assert inner == {10: 2, 11: 1} and outer == {10: 1, 11: 1}


def test_running_budget_keeps_the_crossing_row(spark):
    rows = spark.createDataFrame([("a", i, c) for i, c in enumerate([3, 4, 2, 5, 1])], "g string, i int, cost int")
    got = funnel.running_budget(rows, "g", ["i"], "cost", 8, F.floor(F.col("i") / 2)).orderBy("i").collect()
    assert [r.runs for r in got] == [True, True, True, False, False]
    assert [r.warns for r in got] == [False, False, True, True, True]


def test_resolution_policies(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id long, name string")
    edges = spark.createDataFrame([(1, "b"), (1, "b"), (1, None), (1, "a")], "caller_id long, callee_name string")
    assert [tuple(r) for r in graph.resolve(nodes, edges, "first").collect()] == [(1, 2)]
    assert [tuple(r) for r in graph.resolve(nodes, edges, "last").collect()] == [(1, 3)]


def search(spark, sf_dir):
    """Callees, entries and sinks of the stored graph, resolved in plain Python."""
    first, out = {}, {}
    for r in table(spark, sf_dir, "nodes").select("id", "name").collect():
        if r.name:
            first[r.name] = min(first.get(r.name, r.id), r.id)
    for r in table(spark, sf_dir, "edges").select("caller_id", "callee_name").collect():
        if r.callee_name in first and first[r.callee_name] != r.caller_id:
            out.setdefault(r.caller_id, set()).add(first[r.callee_name])
    entries, sinks = ({r.id for r in table(spark, sf_dir, "nodes").where(c).collect()} for c in ("is_entry", "is_sink"))
    return out, entries, sinks


def text(path):
    return ">".join(map(str, path))


def test_first_sink_to_nine_nodes(spark, sf_dir):
    out, entries, sinks = search(spark, sf_dir)
    want = {}
    for entry in entries:
        seen, front = {entry}, [(entry,)]
        for depth in range(2, 10):
            best = {}
            for p in front:
                for n in out.get(p[-1], set()) - seen:
                    best[n] = min(best.get(n, p + (n,)), p + (n,))
            seen |= set(best)
            want |= {(entry, n): (depth, text(p)) for n, p in best.items() if n in sinks}
            front = [p for n, p in best.items() if n not in sinks]
    got = {(r.entry, r.sink): (r.depth, r.path) for r in graph_queries.QUERIES["paths_to_first_sink_full"](spark, sf_dir).collect()}
    assert got == want and max(depth for depth, _ in got.values()) == 9


def test_comparison_to_eleven_nodes(spark, sf_dir):
    out, entries, sinks = search(spark, sf_dir)
    found, front = [], [(e,) for e in entries]
    for _ in range(10):
        front = [p + (n,) for p in front for n in out.get(p[-1], ()) if n not in p]
        found += [p for p in front if p[-1] in sinks]
    queries = graph_queries.QUERIES
    assert sorted(r.path for r in queries["paths_all_full"](spark, sf_dir).collect()) == sorted(map(text, found))
    called, gates = {}, {r.id for r in table(spark, sf_dir, "nodes").where("is_gate").collect()}
    for r in table(spark, sf_dir, "edges").select("caller_id", "callee_name").collect():
        if re.search(dims.GUARD_STEMS, (r.callee_name or "").lower()):
            called.setdefault(r.caller_id, set()).add(r.callee_name)
    guards = {p: set().union(*(called.get(n, set()) for n in p)) for p in found}
    got = {r.path: r.names for r in queries["path_guards_full"](spark, sf_dir).collect()}
    assert got == {text(p): ",".join(sorted(g)) for p, g in guards.items() if g}
    wanted, paths = {}, {}
    for p in found:
        wanted.setdefault(p[-1], set()).update(guards[p])
        paths.setdefault(p[-1], []).append(p)
    want = {text(p): ",".join(sorted(wanted[p[-1]] - guards[p])) for p in found if len(paths[p[-1]]) > 1 and wanted[p[-1]] - guards[p]}
    assert {r.path: r.missing for r in queries["compare_siblings_full"](spark, sf_dir).collect()} == want
    verdicts = {text(p): "gate on the path" if gates & set(p) else "guard called" if guards[p] else "survives" for p in found}
    assert {r.path: r.verdict for r in queries["rebut_paths_full"](spark, sf_dir).collect()} == verdicts


def ladder(spark, layers, wide):
    """Nodes in layers, each calling the whole next layer; entries are the first, sinks the last and one of the middle."""
    ids = [k * 100 + i for k in range(layers) for i in range(wide)]
    edges = spark.createDataFrame([(a, (a // 100 + 1) * 100 + i) for a in ids if a < (layers - 1) * 100 for i in range(wide)], "src long, dst long")
    return edges, *(spark.createDataFrame([(i,) for i in x], "id long") for x in (range(wide), [layers // 2 * 100, *((layers - 1) * 100 + i for i in range(wide))]))


def stored(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_deep_search_stores_halves_of_paths(spark):
    graph_of = ladder(spark, 11, 3)
    before = stored(spark)
    found = graph.paths(*graph_of, max_nodes=11, keep="all", ahead=True)
    assert found.count() == 3**11 + 3**5
    assert stored(spark) - before < 2_000_000  # the paths alone have 18 MB as rows


def test_deep_search_equals_search_by_hops(spark):
    rnd = random.Random(7)
    edges = spark.createDataFrame(sorted({(a, b) for a, b in ((rnd.randrange(12), rnd.randrange(12)) for _ in range(30)) if a != b}), "src long, dst long")
    entries, sinks = (spark.createDataFrame([(i,) for i in x], "id long") for x in ((0, 1, 2, 5), (2, 7, 9, 11)))
    for most in (2, 3, 4, 7, 10):
        deep, plain = (sorted(map(tuple, graph.paths(edges, entries, sinks, max_nodes=most, keep="all", ahead=x).collect())) for x in (True, False))
        assert deep == plain and deep


@pytest.fixture(scope="module")
def ladder_dir(spark, tmp_path_factory):
    """Tables of the ladder: its edges by name, a guard called from one node and a gate."""
    at = str(tmp_path_factory.mktemp("ladder"))
    edges, entries, sinks = (x.collect() for x in ladder(spark, 11, 3))
    ids = {i for r in edges for i in r}
    rows = [(i, f"f{i}", i in {r.id for r in entries}, i == 301, i in {r.id for r in sinks}) for i in ids] + [(5000, "check_a", False, False, False)]
    spark.createDataFrame(rows, "id long, name string, is_entry boolean, is_gate boolean, is_sink boolean").write.parquet(f"{at}/nodes.parquet")
    calls = [(r.src, f"f{r.dst}") for r in edges] + [(402, "check_a"), (702, "check_a"), (702, "verify_b")]
    spark.createDataFrame(calls, "caller_id long, callee_name string").write.parquet(f"{at}/edges.parquet")
    return at


def test_deep_rebuttal_stores_halves_of_paths(spark, ladder_dir):
    before = stored(spark)
    got = graph_queries.QUERIES["rebut_paths_full"](spark, ladder_dir)
    counts = {r.verdict: r["count"] for r in got.groupBy("verdict").count().collect()}
    gate, short = 3**10, 3**4  # a third of the 3**11 long and 3**5 short paths
    assert counts == {"gate on the path": gate + short, "guard called": 3**9 * 6 * 5 // 9 + 54, "survives": 3**9 * 6 * 4 // 9 + 108}
    assert stored(spark) - before < 4_000_000


def test_deep_guards_store_halves_of_paths(spark, ladder_dir):
    before = stored(spark)
    got = graph_queries.QUERIES["path_guards_full"](spark, ladder_dir)
    counts = {(r.names, r.guards): r["count"] for r in got.groupBy("names", "guards").count().collect()}
    assert counts == {("check_a", 1): 3**9 * 2 + 81, ("check_a,verify_b", 2): 3**10}
    assert stored(spark) - before < 4_000_000


def test_deep_siblings_store_halves_of_paths(spark, ladder_dir):
    before = stored(spark)
    got = graph_queries.QUERIES["compare_siblings_full"](spark, ladder_dir)
    counts = {r.missing: r["count"] for r in got.groupBy("missing").count().collect()}
    assert counts == {"check_a,verify_b": 3**9 * 4, "verify_b": 3**9 * 2, "check_a": 162}
    assert stored(spark) - before < 6_000_000


def test_siblings_by_halves_and_parts_equal_those_by_paths(spark):
    rnd = random.Random(3)
    edges = spark.createDataFrame(sorted({(a, b) for a, b in ((rnd.randrange(8, 22), rnd.randrange(8, 22)) for _ in range(34)) if a != b}), "src long, dst long")
    entries, sinks = (spark.createDataFrame([(i,) for i in x], "id long") for x in ((8, 9, 12, 18), (9, 14, 16, 21)))
    calls = spark.createDataFrame(sorted({(rnd.randrange(8, 22), f"g{rnd.randrange(9)}") for _ in range(16)}), "caller_id long, callee_name string")
    found = graph.paths(edges, entries, sinks, max_nodes=8, keep="all").select("entry", "sink", "path")
    want = graph.compare_siblings(found, graph.guards_of(found, calls, F.lit(True))).collect()
    called = calls.groupBy(F.col("caller_id").alias("node")).agg(F.collect_set("callee_name").alias("own"))
    h = graph.halves(edges, entries, sinks, max_nodes=8, carried=called, empty=F.array().cast("array<string>"), merge=F.array_union)
    for most_rows in (500_000, 9):
        assert sorted(map(tuple, graph.siblings_of_halves(h, most_rows).collect())) == sorted(map(tuple, want)) and want


def test_sibling_is_first_as_text_where_one_middle_begins_another(spark):
    """1>2>3>4>5>12>... comes before 1>2>3>4>5>1..., as the text goes on behind the middle node of a path."""
    calls = [(20, 2), (2, 3), (3, 4), (4, 5), (5, 7), (5, 71), (7, 9), (71, 9), (21, 22), (22, 23), (23, 24), (24, 25), (25, 26), (26, 9)]
    edges = spark.createDataFrame(calls, "src long, dst long")
    entries, sinks = (spark.createDataFrame([(i,) for i in x], "id long") for x in ((20, 21), (9,)))
    called = spark.createDataFrame([(2, ["g"])], "node long, own array<string>")
    h = graph.halves(edges, entries, sinks, max_nodes=11, carried=called, empty=F.array().cast("array<string>"), merge=F.array_union)
    assert [(r.path, r.missing, r.sibling) for r in graph.siblings_of_halves(h).collect()] == [("21>22>23>24>25>26>9", "g", "20>2>3>4>5>71>9")]


def test_deep_siblings_store_no_row_for_a_sink_and_a_guard(spark, tmp_path):
    """All 22 nodes of the ladder call 40 guards of their own; its sinks then know 440 or 840."""
    edges, entries, sinks = (x.collect() for x in ladder(spark, 11, 2))
    ids = sorted({i for r in edges for i in r})
    rows = [(i, f"f{i}", i in {r.id for r in entries}, i in {r.id for r in sinks}) for i in ids]
    spark.createDataFrame(rows, "id long, name string, is_entry boolean, is_sink boolean").write.parquet(f"{tmp_path}/nodes.parquet")
    calls = [(r.src, f"f{r.dst}") for r in edges] + [(i, f"check_{i}_{k}_{'long' * 9}") for i in ids for k in range(40)]
    spark.createDataFrame(calls, "caller_id long, callee_name string").write.parquet(f"{tmp_path}/edges.parquet")
    before = stored(spark)
    got = graph_queries.QUERIES["compare_siblings_full"](spark, str(tmp_path))
    assert stored(spark) - before < 200_000
    some = got.where("path = '0>100>200>300>400>500'").first()
    away = sorted(f"check_{i}_{k}_{'long' * 9}" for i in ids if i % 100 and i < 500 for k in range(40))
    assert some.missing == ",".join(away) and some.score == len(away) / (len(away) + 240) and some.sibling == "0>100>200>300>401>500"


def test_long_ids_stay_whole(spark):
    big = 1234567890123
    nodes = spark.createDataFrame([(1, "a", True, False), (big, "b", False, True), (big + 1, "c", False, True)], "id long, name string, is_entry boolean, is_sink boolean")
    edges = spark.createDataFrame([(1, "b"), (1, "c"), (big, "c")], "caller_id long, callee_name string")
    found = graph.paths(graph.resolve(nodes, edges), nodes.where("is_entry"), nodes.where("is_sink"), max_nodes=4, keep="all")
    assert {r.path for r in found.collect()} == {f"1>{big}", f"1>{big + 1}", f"1>{big}>{big + 1}"}
    assert {r.node for r in graph.path_nodes(found).collect()} == {1, big, big + 1}


def test_running_sums_and_previous_rows_across_slices(spark):
    from quarrylens.operators import running

    rows = [(g, i, i * 7 % 5) for g in ("a", None) for i in range(40) if i not in range(10, 25)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    piece = F.floor(F.col("i") / 4)
    summed = {(r.g, r.i): r.s for r in running.sum_before(df, ["g"], ["i"], piece, F.col("v"), "s").collect()}
    before = {(r.g, r.i): r.p and r.p.v for r in running.previous(df, ["g"], ["i"], piece, ["v"], "p").collect()}
    for g in ("a", None):
        mine = [(i, v) for h, i, v in rows if h == g]
        assert [summed[g, i] for i, _ in mine] == [sum(v for _, v in mine[:k]) for k in range(len(mine))]
        assert [before[g, i] for i, _ in mine] == [None, *(v for _, v in mine[:-1])]
    assert running.sum_before(df.where("false"), ["g"], ["i"], piece, F.col("v"), "s").count() == 0
