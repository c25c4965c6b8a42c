import random

from quarrylens.llm import leakage
from quarrylens.llm.words import words


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "값", "naïve"]
    sentence = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(sentence(40)), "x") for i in range(20)] + [(50, "too short", "x"), (51, None, "x"), (52, " ".join(["same"] * 30), "x")]
    docs = []
    for i in range(200):
        body = sentence(rng.randint(0, 50))
        if i % 3 == 0:
            source = items[rng.randrange(20)][1].split()
            at, n = rng.randrange(20), rng.choice([9, 11, 12, 13, 20])
            body += source[at : at + n] + sentence(5)
        docs.append((i, ", ".join(body).upper() if i % 2 else "\n".join(body), 1))
    docs += [(900, None, 1), (901, "", 1), (902, "same " * 5000, 1)] + [(1000 + i, docs[0][1], 1) for i in range(100)]
    found = leakage.leaks(
        spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    )
    runs = lambda t: {tuple(w[i : i + 12]) for w in [words(t)] for i in range(len(w) - 11)}
    of_item = {i: runs(t) for i, t, _ in items}
    want = {(d, i) for d, t, _ in docs for r in [runs(t)] for i, s in of_item.items() if r & s}
    got = found.collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and (902, 52) in want
    shuffled = leakage.leaks(
        spark.createDataFrame(docs, "doc_id long, text string, n int"), spark.createDataFrame(items, "item_id long, text string, x string"), broadcast_rows=0
    )
    assert {(r.doc_id, r.item_id) for r in shuffled.collect()} == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m", "t", "en")], "item_id long, text string, task string, lang string")
    assert leakage.leaks(docs, items).count() == 0
    assert [r.documents for r in leakage.leaked_items(leakage.leaks(docs, items), items).collect()] == [0]
