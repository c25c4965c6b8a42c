import random

import pytest
from pyspark.sql import functions as F

from quarrylens.llm import mixing

TOPICS = {"code": "function loop return class import".split(), "chat": "hello thanks friend morning coffee".split(), "news": "minister vote election budget law".split()}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(8)
    out = []
    for i in range(900):
        source = rng.choices(list(TOPICS), [0.85, 0.12, 0.03])[0]
        text = " ".join(rng.choice(TOPICS[source] + ["the", "a", "and"]) for _ in range(rng.randint(5, 60)))
        label = source if i % 10 else None
        out.append((i, (label or "").upper() + " " if label and i % 7 == 0 else label, text, source))
    return out + [(2000, "code", None, ""), (2001, "code", "", ""), (2002, "unknown", "loop class", "")]


def test_shares_and_caps(spark, docs):
    df = spark.createDataFrame([d[:3] for d in docs], "doc_id long, source string, text string").withColumn("tokens", F.lit(-1))
    targets = spark.createDataFrame([("code", 0.4, 1), ("chat", 0.4, 2), ("news", 0.2, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.Mixture(df, targets)
    shares = {r.source: r for r in mix.shares().collect()}
    for s in ("code", "chat", "news"):
        assert abs(shares[s].actual_share - shares[s].target_share) < 0.02
    assert shares["none"].actual_share == 0
    chosen = mix.chosen().collect()
    caps = {"code": 1, "chat": 2, "news": 3}
    assert all(1 <= r.repeats <= caps[r.source] for r in chosen) and len({r.doc_id for r in chosen}) == len(chosen)
    truth = {d[0]: d[3] for d in docs}
    unlabelled = [r for r in chosen if r.doc_id < 900 and r.doc_id % 10 == 0]
    right = sum(truth[r.doc_id] == r.source for r in unlabelled)
    assert right >= 0.9 * len(unlabelled)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.Mixture(docs, targets)
    assert mix.chosen().count() == 0 and [r.actual_share for r in mix.shares().collect()] == [0.0]
    some = spark.createDataFrame([(1, "a", "x y")], "doc_id long, source string, text string")
    assert mixing.Mixture(some, targets.where("false")).chosen().count() == 0


def test_given_total(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", "word " * 20) for i in range(400)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.Mixture(df, targets, total_tokens=2000.0)
    assert abs(sum(r.tokens for r in mix.shares().collect()) - 2000) < 100
