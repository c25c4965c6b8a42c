import random

import pytest

from quarrylens.llm import splitting


def check(text, limit, overlap):
    spans = splitting.cut_points(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in spans) or not text
    for (_, b), (c, _) in zip(spans, spans[1:]):
        assert c == b - overlap
    joined = text[: spans[0][1]] + "".join(text[prev[1] : cur[1]] for prev, cur in zip(spans, spans[1:]))
    assert joined == text
    return spans


@pytest.mark.parametrize("limit,overlap", [(50, 10), (200, 0), (333, 60)])
def test_round_trip(limit, overlap):
    rng = random.Random(limit)
    for _ in range(60):
        text = "".join(rng.choice(["foo(bar);", "\n", "\r\n", " ", "한국어", "x" * 70, "}", "a, b", "\n\n", "🙂"]) for _ in range(rng.randint(0, 200)))
        check(text, limit, overlap)


def test_boundaries_are_used():
    text = "def a():\n    return 1\n\n" * 40
    for a, b in check(text, 300, 30)[:-1]:
        assert text[b - 1] == "\n" and (text[b : b + 3] in ("def", "") or text[b] == "\n")
    assert check("x" * 1000, 100, 10)[0] == (0, 100)


def test_limit_must_exceed_overlap():
    with pytest.raises(ValueError):
        splitting.cut_points("abc" * 10, 5, 5)


def test_table(spark):
    values = spark.createDataFrame(
        [("a", 1, "l\n" * 100, 9), ("a", 2, "short", 9), ("a", 3, None, 9), ("a", 4, "", 9), ("b", 5, "y" * 500, 9), ("a", 1, "l\n" * 100, 9)],
        "tbl string, row_id long, text string, max_chars int",
    )
    limits = spark.createDataFrame([("a", 80, 10)], "tbl string, max_chars int, overlap_chars int")
    got = splitting.split_oversized(values, limits).collect()
    assert {r.row_id for r in got} == {1} and len({(r.piece_no) for r in got}) * 2 == len(got)
    whole = splitting.split_oversized(values, limits, keep_whole=True).collect()
    assert {r.row_id for r in whole} == {1, 2, 4}
    assert splitting.split_oversized(values.where("false"), limits).count() == 0
