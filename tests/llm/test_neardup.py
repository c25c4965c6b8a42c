import random

import pytest
from pyspark.sql import functions as F

from quarrylens.llm.neardup import NearDuplicates, connected_labels
from quarrylens.llm.words import words


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, s):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    return {
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= s * len(sets[a] | sets[b])
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(120):
        base = [rng.choice(vocabulary) for _ in range(60)]
        out.append((len(out), " ".join(base)))
        for _ in range(rng.randint(0, 2)):
            edited = list(base)
            for _ in range(rng.randint(0, 4)):
                edited[rng.randrange(60)] = rng.choice(vocabulary)
            out.append((len(out), " ".join(edited)))
    hot = "the same boilerplate text that a third of all records carry without any change at all"
    out += [(1000 + i, hot) for i in range(60)]
    return out + [(2000, None), (2001, ""), (2002, "two words"), (2003, "two words"), (2004, "x " * 20000)]


@pytest.mark.parametrize("width,similarity", [(3, 0.6), (5, 0.8)])
def test_pairs_against_brute_force(spark, rows, width, similarity):
    df = spark.createDataFrame(rows, "id long, body string").withColumn("rep", F.lit(1)).withColumn("size", F.lit(2))
    got = NearDuplicates(df, "id", F.col("body"), width=width, similarity=similarity).pairs().collect()
    assert len(got) == len(set(map(tuple, got)))
    want = brute([(i, t or "") for i, t in rows], width, similarity)
    assert set(map(tuple, got)) == want


def test_long_lists_are_joined_in_parts(spark, rows):
    df = spark.createDataFrame(rows, "id long, body string")
    whole, parts = (set(map(tuple, NearDuplicates(df, "id", F.col("body"), width=3, similarity=0.6, coordinates=32, list_part=p).pairs().collect())) for p in (1000, 7))
    assert whole == parts == brute([(i, t or "") for i, t in rows], 3, 0.6)


def test_groups_cover_every_record_with_shingles(spark, rows):
    df = spark.createDataFrame(rows, "id long, body string")
    near = NearDuplicates(df, "id", F.col("body"), width=3, similarity=0.6)
    groups = {r.id: r for r in near.groups().collect()}
    pairs = brute([(i, t or "") for i, t in rows], 3, 0.6)
    assert all(groups[a].group_id == groups[b].group_id for a, b in pairs)
    assert groups[1000].links == 59 and 2000 not in groups


def test_empty(spark):
    df = spark.createDataFrame([], "id long, body string")
    assert NearDuplicates(df, "id", F.col("body")).pairs().count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(i + 1, i) for i in range(60)], "u long, v long")
    assert {r.label for r in connected_labels(edges).collect()} == {0}
