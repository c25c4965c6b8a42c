"""Near-duplicate records: an inverted join over the coordinates of a min-wise signature.

Every record gets a signature of ``coordinates`` min-hash values over its distinct word shingles. The record is
posted under each (coordinate, value) pair. Two records whose Jaccard similarity is s agree in about
s * coordinates of them, so a pair is kept when at least ``min_matches`` coordinates collide.

Counting all collisions would visit the long posting lists of boilerplate shingles. Instead each record's postings
are ordered by list length, rare first, and only its first ``coordinates - min_matches + prefix_matches`` are merged;
the longest lists are skipped. Any pair with ``min_matches`` collisions still has ``prefix_matches`` of them in both
prefixes, so skipping loses no pair that reaches the threshold. Pairs that pass are verified exactly on the shingle
sets.

Skew: records with one and the same shingle set are folded into a class before anything is posted, so a group of
copies costs one posting. The longest lists of a record never enter the pair join; a list or class of more than ``list_part`` members
is joined in parts. ``class_pairs`` and ``groups`` hold one row per pair of classes or per record; ``pairs`` expands copies where a
contract asks for every pair. Nothing is collected to the driver.

Edge cases: null fields are empty text; a record with fewer words than a shingle has no shingles and no partners;
ids are unique, and rows repeated under one id count as one; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.words import shingle_hashes, words
from quarrylens.session import cut_lineage

_SALT = np.uint64(0x9E3779B97F4A7C15)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 2**62, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**62, n, dtype=np.uint64)


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """Min-hash values (32 bits each) of a non-empty set of 64-bit hashes."""
    a, b = _coefficients(coordinates)
    with np.errstate(over="ignore"):
        return ((hashes[:, None] * a[None, :] + b[None, :]) >> np.uint64(32)).min(axis=0)


def joined_fields(*names: str) -> Column:
    """The fields joined with blanks, null as empty."""
    return F.concat_ws(" ", *(F.coalesce(F.col(n), F.lit("")) for n in names))


def _sketches(coordinates: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.arange(coordinates, dtype=np.uint64) * _SALT
        for pdf in batches:
            ids, keys, sizes, posts = [], [], [], []
            for i, text in zip(pdf["id"], pdf["text"]):
                h = np.unique(shingle_hashes(words(text), width))
                if not len(h):
                    continue
                with np.errstate(over="ignore"):
                    element = (signature(h, coordinates) * np.uint64(0xD6E8FEB86659FD93)) ^ place
                    key = np.bitwise_xor.reduce(h * _SALT) ^ np.uint64(len(h)) ^ h.sum()
                ids.append(i)
                keys.append(key.astype(np.int64))
                sizes.append(len(h))
                posts.append(element.astype(np.int64))
            yield pd.DataFrame({"id": ids, "set_key": keys, "size": sizes, "postings": posts})

    return run


def _shingle_sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [np.unique(shingle_hashes(words(t), width)).astype(np.int64) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "shingles": sets})

    return run


class NearDuplicates:
    """Classes of equal shingle sets, similar class pairs, and what follows from them."""

    def __init__(self, df: DataFrame, id_col: str, text: Column, *, width: int = 5, similarity: float = 0.8,
                 coordinates: int = 64, min_matches: int | None = None, prefix_matches: int = 3, list_part: int = 1000):
        self.similarity, self.width, self.list_part = similarity, width, list_part
        if min_matches is None:  # 3.3 standard deviations under the expected number of collisions
            expected = coordinates * similarity
            min_matches = int(expected - 3.3 * (expected * (1 - similarity)) ** 0.5 + 0.5)
        self.min_matches = max(prefix_matches, min_matches)
        self.prefix_matches = prefix_matches
        self.prefix = coordinates - self.min_matches + prefix_matches
        self.texts = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where("id is not null")
        sketch = self.texts.mapInPandas(
            _sketches(coordinates, width), "id long, set_key long, size int, postings array<long>"
        )
        self.sketches = cut_lineage(sketch)
        self.members = self.sketches.groupBy("id").agg(F.min("set_key").alias("set_key"))
        self.classes = self.members.groupBy("set_key").agg(
            F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")
        )

    def class_pairs(self) -> DataFrame:
        """rep_a < rep_b, similarity: representatives of different classes that are alike enough."""
        reps = self.sketches.groupBy("set_key").agg(
            F.min("id").alias("id"), F.first("size").alias("size"), F.first("postings").alias("postings")
        )
        # One exchange on the element serves both the list lengths and their join back.
        post = reps.select("id", "size", F.explode("postings").alias("element")).repartition("element")
        lists = post.groupBy("element").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
        # A posting alone in its list can't collide; it only takes a place at the front of the order.
        shared = post.join(lists, "element")
        ordered = shared.groupBy("id", "size").agg(
            F.array_sort(F.collect_list(F.struct("length", "element"))).alias("shared")
        )
        coordinates = self.prefix + self.min_matches - self.prefix_matches
        alone = F.lit(coordinates) - F.size("shared")
        prefix = cut_lineage(ordered.where(alone < self.prefix).select(
            "id", "size", F.explode(F.slice("shared", F.lit(1), (F.lit(self.prefix) - alone).cast("int"))).alias("p")
        ).select("id", "size", F.col("p.element").alias("element"), F.ceil(F.col("p.length") / self.list_part).cast("int").alias("parts")))
        # A long list is met in parts: one side stands in each part, the other in one.
        a = prefix.select("element", "id", "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).alias("a")
        b = prefix.select("element", "id", "size", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part")).alias("b")
        ratio = self.similarity
        hits = a.join(
            b,
            (F.col("a.element") == F.col("b.element"))
            & (F.col("a.part") == F.col("b.part"))
            & (F.col("a.id") < F.col("b.id"))
            & (F.col("a.size") >= F.col("b.size") * ratio)
            & (F.col("b.size") >= F.col("a.size") * ratio),
        ).select(F.col("a.id").alias("rep_a"), F.col("b.id").alias("rep_b"))
        counted = hits.groupBy("rep_a", "rep_b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.prefix_matches)
        candidates = cut_lineage(counted.select("rep_a", "rep_b"))
        needed = candidates.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
        sets = (
            self.texts.join(needed, "id")
            .mapInPandas(_shingle_sets(self.width), "id long, shingles array<long>").dropDuplicates(["id"])
        )
        both = candidates.join(sets.select(F.col("id").alias("rep_a"), F.col("shingles").alias("sa")), "rep_a").join(
            sets.select(F.col("id").alias("rep_b"), F.col("shingles").alias("sb")), "rep_b"
        )
        common = F.size(F.array_intersect("sa", "sb"))
        return (
            both.select("rep_a", "rep_b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity"))
            .where(F.col("similarity") >= self.similarity)
        )

    def pairs(self) -> DataFrame:
        """id_a < id_b of all alike records; copies are expanded."""
        byrep = self.members.join(self.classes, "set_key").select("id", "rep", "copies")
        parts = F.ceil(F.col("copies") / self.list_part).cast("int")
        inside = byrep.where("copies > 1")
        x = inside.select("rep", "id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).alias("a")
        y = inside.select("rep", "id", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part")).alias("b")
        same = x.join(y, (F.col("a.rep") == F.col("b.rep")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.id") < F.col("b.id")))
        same = same.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
        linked = self.class_pairs()
        m = byrep.select("id", "rep")
        across = (
            linked.join(m.select(F.col("id").alias("x"), F.col("rep").alias("rep_a")), "rep_a")
            .join(m.select(F.col("id").alias("y"), F.col("rep").alias("rep_b")), "rep_b")
            .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        )
        return same.unionByName(across)

    def groups(self, max_rounds: int = 30) -> DataFrame:
        """id, group_id (smallest id reached over links), links (other records it is directly alike to)."""
        linked = cut_lineage(self.class_pairs())
        size = self.classes.select("rep", "copies")
        edges = linked.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v"))
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        label = connected_labels(edges, max_rounds)
        degree = (
            edges.join(size.withColumnRenamed("rep", "v"), "v").groupBy("u").agg(F.sum("copies").alias("others"))
        )
        out = (
            self.members.join(self.classes, "set_key")
            .join(label.select(F.col("node").alias("rep"), "label"), "rep", "left")
            .join(degree.withColumnRenamed("u", "rep"), "rep", "left")
        )
        return out.select(
            "id",
            F.coalesce("label", "rep").alias("group_id"),
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )


def connected_labels(edges: DataFrame, max_rounds: int = 30) -> DataFrame:
    """node, label: the smallest node of its component, by min-label passing with pointer jumping.

    ``edges`` holds both directions (u, v). Lineage is cut each round; rounds grow with the logarithm of the longest
    chain. Raises if the labels haven't settled after ``max_rounds``.
    """
    edges = edges.distinct()
    labels = cut_lineage(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "node"))
    for _ in range(max_rounds):
        around = (
            edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        )
        step = labels.join(around.withColumnRenamed("u", "node"), "node", "left").select(
            "node", "label", F.least("label", "near").alias("next")
        )
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        new = cut_lineage(
            step.join(jump, "next", "left").select("node", F.least("next", "beyond").alias("label"), F.col("label").alias("old"))
        )
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
