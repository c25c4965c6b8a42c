import random

from quarrylens.llm import provenance

SCHEMA = "tbl string, repo string, file_path string, code string, made boolean"
WORDS = "archive ledger packet cursor shard ticket window session gateway layout".split()


def hand(seed, n=14):
    rng = random.Random(seed)
    return "def f():\n" + "\n".join(f"    {rng.choice(WORDS)}_{rng.choice(WORDS)} = load({rng.randint(1, 10**6)}, {rng.choice(WORDS)})" + " or other" * rng.randint(0, 2) for _ in range(n))


def judge(spark, rows):
    df = spark.createDataFrame([(*r, False) for r in rows], SCHEMA)
    return {(r.repo, r.file_path): r.why for r in provenance.judge_files(df).collect()}


def test_kinds(spark):
    copied = [hand(k) for k in range(3)]
    counted = "\n".join(f"case_{i} = make({i}, 'ab{i:04d}')" for i in range(40))
    data = "TABLE = [" + ", ".join(str(i * 7919 % 9973) for i in range(300)) + "]"
    compact = "".join(f"for(var a=0;a<b.length;a++)c(b[a]);!function(d){{d.e={i}}}(f);" for i in range(20))
    rows = [
        ("n", "r1", "src/own.py", hand(100)), ("n", "r1", "src/own.py", hand(101)), ("n", "r2", "generators/own.py", hand(102)),
        ("n", "r2", "vendors/own.py", hand(103)), ("n", "r3", "src/third_party_rates.py", "# do not edit the file while a run is active\n" + hand(104)),
        ("n", "r1", "vendor/lib/a.py", hand(105)), ("n", "r1", "a_pb2.py", hand(106)), ("n", "r1", "a.min.js", hand(107)),
        ("n", "r4", "src/g.py", "# Code generated by toolx. DO NOT EDIT.\n" + hand(108)), ("n", "r4", "src/c.py", counted), ("n", "r4", "src/d.py", data),
        ("n", "r4", "src/m.js", compact), ("n", "r5", "lib/x/helpers.py", "\n".join(copied)), ("n", "r6", "core/y/compat.py", "\n".join(copied) + "\nextra_line = added_here(1)"),
        ("n", "r6", "core/mixed.py", data), ("n", "r6", "core/mixed.py", hand(109, 60)), ("n", None, "src/own.py", None), ("n", "r7", None, counted), ("n", "r7", "src/e.py", ""),
    ]
    got = judge(spark, rows)
    assert got == {
        ("r1", "vendor/lib/a.py"): "copied", ("r1", "a_pb2.py"): "made", ("r1", "a.min.js"): "compact", ("r4", "src/g.py"): "made",
        ("r4", "src/c.py"): "composition", ("r4", "src/d.py"): "composition", ("r4", "src/m.js"): "composition",
        ("r5", "lib/x/helpers.py"): "contained", ("r6", "core/y/compat.py"): "contained",
    }


def test_library_in_very_many_repositories(spark):
    body = "\n".join(hand(k) for k in range(3))
    rows = [("n", f"repo{i}", f"lib/z{i}.py", body + f"\nown_line_of_copy = {i}") for i in range(150)]
    rows += [("n", f"repo{i}", f"src/own{i}.py", hand(1000 + i, 20)) for i in range(150)]
    got = judge(spark, rows)
    assert len(got) == 150 and set(got.values()) == {"contained"}


def test_empty_and_very_long(spark):
    assert judge(spark, [("n", "r", "a.py", "x = 1")]) == {}
    df = spark.createDataFrame([], SCHEMA)
    assert provenance.judge_files(df).count() == 0
    assert judge(spark, [("n", "r", "a.py", hand(1, 20000)), ("n", "r", "b.py", hand(2, 20))]) == {}


def test_comments_are_judged_by_cues():
    for text in ("# This module is emitted automatically from api.yaml; do not change.", "// AUTO-GENERATED FILE - DO NOT MODIFY", "x = 1\n# datei automatisch generiert von werkzeug",
                 "# @generated", "/* Generated from rates.proto by protoplan. Don't edit. */"):
        assert provenance.marks(text) == (True, False), text
    for text in ("# Bundled from leftpad v1.3.0", "// copied from the colorlib project, licence MIT", "# third-party, unmodified", "// Taken verbatim from requests 2.31.0"):
        assert provenance.marks(text) == (False, True), text
    for text in ("# The generated id is returned to the caller", "# Copyright (c) 2020 own authors. Part of app.", "# keys are created automatically", "# imported rows go upstream",
                 "# do not edit the file while a run is active", "x = 'vendored'", "", "// generated output is cached"):
        assert provenance.marks(text) == (False, False), text


def test_note_behind_a_long_table_is_read(spark):
    table = "TABLE = [\n" + "\n".join(f"    {i * 7919 % 9973}," for i in range(500)) + "\n]\n"
    got = judge(spark, [("n", "r", "src/t.py", table + "# vendored from ratelib 2.1\n"), ("n", "r", "src/t.py", hand(3, 400))])
    assert got == {("r", "src/t.py"): "copied"}


def test_file_whose_lines_many_hold_but_only_one_contains(spark):
    libraries = [hand(k, 12).splitlines()[1:] for k in range(3)]
    rows = [("n", f"r{k}_{i}", f"lib/z{i}.py", "\n".join(lines) + "\n" + hand(5000 + 100 * k + i, 40)) for k, lines in enumerate(libraries) for i in range(90)]
    rows += [("n", "whole", "all.py", "\n".join(x for lines in libraries for x in lines) + "\n" + hand(9001, 60))]
    rows += [("n", "part", "some.py", "\n".join(x for lines in libraries for x in lines[:7]))]
    assert judge(spark, rows) == {("part", "some.py"): "contained"}
