"""Call graph: name resolution, neighbourhoods, owners of lines, bounded paths, comparison of sibling paths.

Edges name their callee, so every step is an equi-join on the name. Names that no node has drop out of the first join; a
name that many nodes have resolves to one of them (``first`` or ``last``) or, within a repository, to all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.session import cut_lineage

Merge = Callable[[Column, Column], Column]


def resolve(nodes: DataFrame, edges: DataFrame, policy: str = "first") -> DataFrame:
    """src, dst for edges (caller_id, callee_name). Edges are made distinct before the join, so a callee with a third of
    all rows meets its single node in a broadcast or AQE-split join, never in a product."""
    pick = {"first": F.min, "last": F.max}[policy]
    target = nodes.where("name is not null and name <> ''").groupBy("name").agg(pick("id").alias("dst"))
    known = edges.where("callee_name is not null and callee_name <> ''").select("caller_id", "callee_name").distinct()
    return known.join(target, known.callee_name == target.name).where("caller_id <> dst").select(F.col("caller_id").alias("src"), "dst").distinct()


def resolve_in_repo(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All functions of the caller's repository with the called name."""
    caller = nodes.select(F.col("id").alias("caller_id"), F.col("repo").alias("caller_repo"))
    callee = nodes.select(F.col("id").alias("dst"), F.col("repo").alias("callee_repo"), F.col("name").alias("callee_name"))
    e = edges.select("caller_id", "callee_name").distinct().join(caller, "caller_id")
    return e.join(callee, (e.callee_name == callee.callee_name) & (e.caller_repo == callee.callee_repo)).where("caller_id <> dst").select(
        F.col("caller_id").alias("src"), "dst"
    ).distinct()


def owners(points: DataFrame, spans: DataFrame, key: list[str], line: str, start: str, end: str, keep: str = "innermost") -> DataFrame:
    """The span (id) that holds each point: an equi-join on the key (repository and file) with a range condition, then the latest or earliest start."""
    order = F.col(start).desc() if keep == "innermost" else F.col(start).asc()
    both = points.join(spans, key).where((F.col(line) >= F.col(start)) & (F.col(line) <= F.col(end)))
    rank = F.row_number().over(W.partitionBy("point_id").orderBy(order, F.col("span_id")))
    return both.withColumn("r", rank).where("r = 1").drop("r")


def _towards(edges: DataFrame, sinks: DataFrame, hops: int) -> DataFrame:
    """The edges whose end is at most ``hops`` calls from a sink, with that number as ``togo``: a search backwards from all sinks at once."""
    front = cut_lineage(sinks.select(F.col("id").alias("dst")).distinct().withColumn("togo", F.lit(0)))
    reach = front
    for togo in range(1, hops + 1):
        before = edges.join(front.select("dst"), "dst").select(F.col("src").alias("dst")).distinct()
        front = cut_lineage(before.join(reach, "dst", "left_anti").withColumn("togo", F.lit(togo)))
        if front.isEmpty():
            break
        reach = reach.unionByName(front)
    return cut_lineage(edges.join(reach, "dst").select("src", "dst", "togo"))


def _differ(node: Column, others: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (node != F.col(n) for n in others))


def _levels(front: DataFrame, calls: DataFrame, names: list[str], most: int, merge: Merge | None) -> list[DataFrame]:
    """Simple paths of 2, 3, ... ``len(names)`` nodes, a column for each, from the nodes of ``front``; ``togo`` is what the last one lacks to a sink.
    All but the longest are cut: those are read where they are needed, a hop from the cut ones before them."""
    levels = []
    for k in range(1, len(names)):
        near = calls.where(F.col("togo") <= most - 1 - k)
        own = [merge(F.col("own"), F.col("mark")).alias("own")] if merge else []
        hop = front.drop("togo").join(near, F.col(names[k - 1]) == F.col("src")).where(_differ(F.col("dst"), names[:k]))
        front = hop.select(*names[:k], F.col("dst").alias(names[k]), "togo", *own)
        if k < len(names) - 1:
            front = cut_lineage(front)
        levels.append(front)
    return levels


class Halves(NamedTuple):
    """All simple paths as ``whole`` ones of few nodes, and ``heads`` whose last node is the first (``mid``) of ``tails`` that end in a sink.
    What the nodes carry is merged in ``own``."""

    whole: DataFrame
    heads: DataFrame
    tails: DataFrame
    before: list[str]
    after: list[str]
    merge: Merge | None


def halves(edges: DataFrame, entries: DataFrame, sinks: DataFrame, *, max_nodes: int, carried: DataFrame | None = None, empty: Column | None = None,
           merge: Merge | None = None) -> Halves:
    """Every simple path from entries to sinks, searched from its middle: only halves are stored and shuffled, and they are about as many as the root of
    the paths. ``carried`` has node, own; ``empty`` stands for nodes without; ``merge`` joins the values of two parts."""
    half = (max_nodes + 1) // 2
    before, after = [f"n{k}" for k in range(1, half + 1)], [f"n{k}" for k in range(half + 1, max_nodes + 1)]
    calls = _towards(edges, sinks, max_nodes - 2)
    start = entries.select(F.col("id").alias(before[0])).distinct()
    if merge:
        value = F.coalesce(F.col("own"), empty)
        calls = cut_lineage(calls.join(carried.withColumnRenamed("node", "dst"), "dst", "left").select("src", "dst", "togo", value.alias("mark")))
        start = start.join(carried.withColumnRenamed("node", before[0]), before[0], "left").select(before[0], value.alias("own"))
    own = ["own"] if merge else []
    none = F.lit(None).cast("long")
    levels = _levels(cut_lineage(start), calls, before, max_nodes, merge)
    whole = [hop.where("togo = 0").select(*before[:k], *(none.alias(n) for n in before[k:]), F.col(before[k - 1]).alias("sink"), F.lit(k).alias("depth"), *own)
             for k, hop in enumerate(levels, 2)]
    heads = levels[-1].select(*before, *own)
    mids = heads.select(F.col(before[-1]).alias("mid")).distinct()
    if merge:
        mids = mids.withColumn("own", empty)  # its own value is in the heads
    ends = _levels(cut_lineage(mids), calls, ["mid", *after], max_nodes - half + 1, merge)
    tails = [hop.where("togo = 0").select("mid", *after[:k], *(none.alias(n) for n in after[k:]), F.col(after[k - 1]).alias("sink"), F.lit(half + k).alias("depth"), *own)
             for k, hop in enumerate(ends, 1)]
    return Halves(reduce(DataFrame.unionByName, whole), heads, reduce(DataFrame.unionByName, tails), before, after, merge)


def path_text(nodes: list[str]) -> Column:
    return F.concat_ws(">", *(F.col(n).cast("string") for n in nodes))


def pairs(h: Halves) -> DataFrame:
    """The paths of heads and tails: entry, sink, depth, path and own, and what else the two have. A tail shares no node with its head but the middle."""
    heads = h.heads.withColumn("text_before", path_text(h.before))  # once a half, not once a path
    tails = h.tails.withColumnRenamed("own", "own_after").withColumn("text_after", path_text(h.after))
    apart = reduce(lambda a, b: a & b, (F.col(n).isNull() | _differ(F.col(n), h.before[:-1]) for n in h.after))
    both = tails.join(heads, F.col(h.before[-1]) == F.col("mid")).where(apart)  # in this order the rows of a tail follow each other
    both = both.withColumns({"entry": F.col(h.before[0]), "path": F.concat("text_before", F.lit(">"), "text_after")})
    return both.withColumn("own", h.merge(F.col("own"), F.col("own_after"))) if h.merge else both


def all_paths(h: Halves) -> DataFrame:
    """entry, sink, depth, path and own. Equal rows can't come: a path is cut in one place, and edges and entries are distinct."""
    columns = ["entry", "sink", "depth", "path", *(["own"] if h.merge else [])]
    whole = h.whole.withColumns({"entry": F.col(h.before[0]), "path": path_text(h.before)})
    return whole.select(columns).unionByName(pairs(h).select(columns))


def _placed(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the row's place in the order, from 0 without gaps, and cuts: rows are numbered in the slices of the sort, of which only the sizes are collected."""
    rows = cut_lineage(df.orderBy(order).withColumn(name, F.monotonically_increasing_id()))
    piece = F.shiftright(name, 33)
    sizes = {r.piece: r["count"] for r in rows.groupBy(piece.alias("piece")).count().collect()}
    starts = [sum(n for p, n in sizes.items() if p < k) for k in range(max(sizes, default=0) + 1)]
    return rows.withColumn(name, F.array(*map(F.lit, starts))[piece.cast("int")].cast("long") + F.col(name).bitwiseAND((1 << 33) - 1))


def numbered(names: DataFrame) -> DataFrame:
    """name, number: distinct names, numbered in their order."""
    return _placed(names.distinct(), "name", "number").withColumn("number", F.col("number").cast("int"))


def _carry_numbers(h: Halves) -> tuple[Halves, DataFrame]:
    """Halves that carry numbers instead of names, and the names."""
    own = reduce(DataFrame.unionByName, (df.select("own") for df in (h.whole, h.heads, h.tails)))
    names = numbered(own.select(F.explode("own").alias("name")))
    numbers = own.distinct().select("own", F.explode("own").alias("name")).join(names, "name").groupBy("own").agg(F.collect_list("number").alias("numbers"))
    numbers = cut_lineage(numbers)

    def replaced(df: DataFrame) -> DataFrame:
        return df.join(numbers, "own", "left").withColumn("own", F.coalesce("numbers", F.array().cast("array<int>"))).drop("numbers")

    return h._replace(whole=replaced(h.whole), heads=replaced(h.heads), tails=replaced(h.tails)), names


def _first_holders(h: Halves) -> DataFrame:
    """sink, first: the first paths (by, guard) to the sink that have a guard no path before them has, one more than a path has guards.

    Paths are put together in slices of their entries, in the order of their text, which begins with the entry. A sink that has all it needs is left out of the
    slices that follow, so few paths are put together here, and the last slice goes to the end.
    """
    begin = F.concat(F.col(h.before[0]).cast("string"), F.lit(">"))
    entries = cut_lineage(h.whole.unionByName(h.heads, allowMissingColumns=True).groupBy(begin.alias("begin")).agg(F.max(F.size("own")).alias("n")))
    longest = sum(df.agg(F.max(n)).first()[0] or 0 for df, n in ((entries, "n"), (h.tails, F.size("own"))))
    n = entries.count()
    places = _placed(entries.select("begin"), "begin", "place").where(F.col("place").isin([n >> 9, n >> 6, n >> 3]) & (F.col("place") > 0))
    bounds = sorted(r.begin for r in places.collect())
    found = full = None
    for low, high in zip([None, *bounds], [*bounds, None]):
        here = (F.lit(True) if low is None else begin >= low) & (F.lit(True) if high is None else begin < high)
        some = h._replace(whole=h.whole.where(here), heads=h.heads.where(here))
        if full is not None:
            some = some._replace(whole=some.whole.join(full, "sink", "left_anti"), tails=some.tails.join(full, "sink", "left_anti"))
        new = all_paths(some).select("sink", F.explode("own").alias("guard"), F.col("path").alias("by"))
        found = cut_lineage((new if found is None else found.unionByName(new)).groupBy("sink", "guard").agg(F.min("by").alias("by")))
        full = F.broadcast(found.groupBy("sink").count().where(F.col("count") > longest).select("sink"))
    return found.groupBy("sink").agg(F.slice(F.sort_array(F.collect_list(F.struct("by", "guard"))), 1, longest + 1).alias("first"))


def _guards_of_sinks(h: Halves) -> DataFrame:
    """sink, every: the sorted numbers of all guards of its paths. They are gathered as bits of words of 64, since many tasks find the same ones."""
    both = pairs(h._replace(merge=None)).select("sink", F.explode(F.concat("own", "own_after")).alias("guard"))  # a guard may come twice
    both = both.unionByName(h.whole.select("sink", F.explode("own").alias("guard")))
    bit = F.expr("shiftleft(1L, guard & 63)")
    words = both.groupBy("sink", F.shiftright("guard", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    words = words.groupBy("sink").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    places = F.sequence(F.lit(0), F.lit(63))
    numbers = F.transform("words", lambda w: F.transform(F.filter(places, lambda i: F.getbit(w.bits, i) == 1), lambda i: w.word * 64 + i))
    return words.select("sink", F.flatten(numbers).alias("every"))


def siblings_of_halves(h: Halves, most_rows: int = 4_000_000, names: DataFrame | None = None) -> DataFrame:
    """compare_siblings over paths in halves: put together once for the guards of each sink, in part for its first paths, and once to compare.

    Halves carry numbers of ``names`` (name, number), or the names themselves, which are numbered first. What a sink knows meets its paths by broadcast, in as
    many parts as its numbers need, so that paths are never stored or shuffled, and no row stands for a sink and a guard.
    """
    if names is None:
        h, names = _carry_numbers(h)
    # a path has at most ``longest`` guards, so one of the first ``longest`` + 1 holders of others is the first
    known = cut_lineage(_guards_of_sinks(h).join(_first_holders(h), "sink"))
    parts = max(1, -(-(known.agg(F.sum(F.size("every"))).first()[0] or 0) // most_rows))
    both = all_paths(h)
    for k in range(parts):
        mine = known.where(F.pmod(F.hash("sink"), F.lit(parts)) == k).select("sink", F.col("every").alias(f"every{k}"), F.col("first").alias(f"first{k}"))
        both = both.join(F.broadcast(mine), "sink", "left")
    both = both.withColumns({x: F.coalesce(*(f"{x}{k}" for k in range(parts))) for x in ("every", "first")}).where("size(own) < size(every)")
    named = names.agg(F.sort_array(F.collect_list(F.struct("number", "name"))).alias("named")).select("named.name")
    both = both.withColumn("missing", F.array_except("every", "own")).crossJoin(F.broadcast(named))  # one row
    others = F.filter("first", lambda e: ~F.array_contains("own", e.guard))
    return both.select(
        "entry", "sink", "path", F.array_join(F.transform("missing", lambda n: F.col("name")[n]), ",").alias("missing"), (F.size("missing") / F.size("every")).alias("score"),
        others[0].by.alias("sibling"),
    )


def paths(edges: DataFrame, entries: DataFrame, sinks: DataFrame, *, max_nodes: int = 5, stop_at_sink: bool = False,
          keep: str = "shortest", ahead: bool = False) -> DataFrame:
    """entry, sink, depth, path (ids joined with ``>``) of bounded simple paths from entries to sinks.

    A frontier is joined with the edges hop by hop; its lineage is cut each hop. With ``shortest`` a node is visited once
    per entry, by its smallest path (an anti-join against what the entry has seen), so the work is bounded by entries times
    nodes; with ``all`` every simple path is kept and ``max_nodes`` bounds the depth. ``ahead`` follows only nodes from which a sink
    can still be reached within the bound; it loses no path, and deep searches need it. For ``all`` it then searches by halves.
    """
    if ahead and keep == "all" and not stop_at_sink and max_nodes > 2:
        return all_paths(halves(edges, entries, sinks, max_nodes=max_nodes))
    frontier = cut_lineage(entries.select(F.col("id").alias("entry"), F.col("id").alias("node"), F.array("id").alias("path")).distinct())
    seen = frontier.select("entry", "node")
    found = None
    marks = sinks.select(F.col("id").alias("node")).distinct()
    if ahead:
        edges = _towards(edges, sinks, max_nodes - 2)
    for depth in range(2, max_nodes + 1):
        calls = edges.where(F.col("togo") <= max_nodes - depth) if ahead else edges
        hop = frontier.join(calls, frontier.node == calls.src).where(~F.array_contains("path", F.col("dst"))).select(
            "entry", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path")
        )
        if keep == "shortest":
            hop = hop.groupBy("entry", "node").agg(F.min("path").alias("path")).join(seen, ["entry", "node"], "left_anti")
        hop = cut_lineage(hop)
        if hop.isEmpty():
            break
        hits = hop.join(marks, "node", "left_semi").select("entry", F.col("node").alias("sink"), F.lit(depth).alias("depth"), "path")
        found = hits if found is None else found.unionByName(hits)
        if keep == "shortest":
            seen = seen.unionByName(hop.select("entry", "node"))
        frontier = hop.join(marks, "node", "left_anti") if stop_at_sink else hop
    if found is None:
        found = frontier.limit(0).select("entry", F.col("node").alias("sink"), F.lit(0).alias("depth"), "path")
    return found.select("entry", "sink", "depth", F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"))


def path_nodes(found: DataFrame) -> DataFrame:
    """path, node: the members of each path."""
    return found.select("path", F.explode(F.split("path", ">")).alias("n")).select("path", F.col("n").cast("long").alias("node")).distinct()


def guards_of(found: DataFrame, edges: DataFrame, is_guard: Column) -> DataFrame:
    """path, guard: guard names called by any node of a path."""
    called = edges.where(is_guard).select(F.col("caller_id").alias("node"), F.col("callee_name").alias("guard")).distinct()
    return path_nodes(found).join(called, "node").select("path", "guard").distinct()


def compare_siblings(found: DataFrame, guards: DataFrame) -> DataFrame:
    """Paths that miss a guard which another path to the same sink has: missing guards, the share they are, and the first path that has one.

    The guards of a path are an array, those of a sink the union over its paths with the first path of each; a path is compared with its
    sink's array, so no row stands for a path and a guard, and paths never meet paths.
    """
    mine = guards.groupBy("path").agg(F.array_sort(F.collect_set("guard")).alias("own"))
    with_own = found.join(mine, "path", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    per_sink = with_own.groupBy("sink").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    first = with_own.select("sink", "path", F.explode("own").alias("guard")).groupBy("sink", "guard").agg(F.min("path").alias("by"))
    union = first.groupBy("sink").agg(F.array_sort(F.collect_list(F.struct("guard", "by"))).alias("every"))
    both = with_own.join(per_sink.join(union, "sink"), "sink").withColumn("missing", F.filter("every", lambda e: ~F.array_contains(F.col("own"), e.guard)))
    return both.where("size(missing) > 0").select(
        "entry", "sink", "path", F.array_join(F.transform("missing", lambda e: e.guard), ",").alias("missing"), (F.size("missing") / F.size("every")).alias("score"),
        F.array_min(F.transform("missing", lambda e: e.by)).alias("sibling"),
    )
