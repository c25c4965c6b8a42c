from quarrylens.llm import truncation

LINES = ["the worker keeps the archive", "a gateway returns the packet", "every ticket stays pending", "our probe drops the session"]
SCHEMA = "tbl string, row_id long, source string, text string, code boolean"


def corpus(n=60):
    text = lambda i: ". ".join(LINES[(i + k) % 4] for k in range(4)) + "."
    return [("t", i, "s", text(i), False) for i in range(n)]


def judged(spark, extra):
    df = spark.createDataFrame(corpus() + extra, SCHEMA + ", share double".replace(", share double", ""))
    return {r.row_id: r for r in truncation.judge(df).collect()}


def test_cut_and_whole(spark):
    base = ". ".join(LINES)
    got = judged(spark, [
        ("t", 101, "s", base + ". the worker keeps the arch", False), ("t", 102, "s", base + ". the worker keeps", False),
        ("t", 103, "s", base, False), ("t", 104, "s", base + ".\n", False), ("t", 105, "s", base + ". a gatew… [truncated]", False),
        ("t", 106, "s", "see `the worker keeps the archive", False), ("t", 107, "s", '{"a": "the worker', False),
        ("t", 108, "s", "def f(x):\n    return [x", True), ("t", 109, "s", "```\ncode\n", False),
        ("t", 110, "s", "the log was marked [truncated] by the tool.", False),
    ])
    cut = {i for i, r in got.items() if r.cut}
    assert {101, 102, 105, 106, 107, 108, 109} <= cut
    assert not cut & ({103, 104, 110} | set(range(60)))


def test_null_empty_repeats_and_length_limit(spark):
    texts = [("t", 200 + i, "u", ("the worker keeps the archive. " * 20)[: 300], False) for i in range(12)]
    varied = [("t", 300 + i, "u", "the worker keeps the archive. " * (5 + i), False) for i in range(12)]
    got = judged(spark, [*texts, *varied, ("t", 1, None, None, False), ("t", 2, None, "", False), ("t", 3, None, "  \n", False)])
    assert got.get(3) is None or got[3].row_id == 3
    whole = {r.cut for i, r in got.items() if 200 <= i < 212}
    assert len(whole) == 1  # equal texts are judged alike
    assert not any(got[i].cut for i in range(300, 312))


def test_empty_table_and_shares(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert truncation.judge(empty).count() == 0
    df = spark.createDataFrame(corpus(20) + [("t", 900, None, "", False), ("t", 901, None, "the worker keeps the arch", False)], SCHEMA)
    shares = {(r.tbl, r.source): r for r in truncation.cut_shares(df, truncation.judge(df)).collect()}
    assert shares["t", "s"].cut_rows == 0 and shares["t", None].rows == 2 and shares["t", None].texts == 1
    assert shares["t", None].cut_share == 1.0


def test_open_structures():
    assert truncation.open_structure("a = 'x'\n# it's fine", True) == ""
    assert truncation.open_structure('f("""doc\n', True) == "string"
    assert truncation.open_structure("for x in y:", True) == "block"
    assert truncation.open_structure('{"a": 1}', False) == ""


def test_every_length_limit_and_copies(spark):
    text = lambda i, n: f"{i:03d} the worker keeps the archive {'packet ' * 60}"[:n]
    rows = [("t", i, "u", text(i, 200), False) for i in range(40)] + [("t", 100 + i, "u", text(i, 300), False) for i in range(40)]
    rows += [("t", 200 + i, "u", text(1, 350), False) for i in range(90)]
    rows += [("t", 300 + i, "u", text(i, 110 + i), False) for i in range(60)]
    got = {r.row_id: r.at_limit for r in truncation.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(40)) and all(got[100 + i] for i in range(40))
    assert not any(got[200 + i] for i in range(90)) and sum(got[300 + i] for i in range(60)) == 0


def test_last_words_reach_back_as_far_as_needed():
    from quarrylens.llm.truncation import _WORD, _last_words

    for body in ("", "one", "a b c d e f", "x " * 500 + "tail", "first " + "y" * 2000, "first second " + "z" * 5000 + " w" * 3, "." * 900 + " end"):
        assert _last_words(body)[-4:] == _WORD.split(body)[-4:], body[:30]
