"""Chunks, taggers, syntax trees and sources on small inputs."""

import json

from pyspark.sql import functions as F

from quarrylens.functions import syntax
from quarrylens.functions import text as T
from quarrylens.operators import chunks, signals
from quarrylens.sources import files


def test_window_ranges(spark):
    df = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(250)), "x"), (2, None, "x"), (3, "", "x"), (4, "  \n \n", "x")], "id int, code string, chunk string")
    got = chunks.line_windows(df, "id", "code").collect()
    assert [(r.start_line, r.end_line) for r in got if r.id == 1] == [(1, 80), (71, 150), (141, 220), (211, 250)]
    assert {r.id for r in got} == {1}


def test_lines_and_names(spark):
    df = spark.createDataFrame([("a\r\nb\n", "x/y.PY"), ("", "z"), (None, None)], "t string, p string")
    got = df.select(T.lines("t").alias("l"), T.language("p").alias("g")).collect()
    assert [r.l for r in got] == [["a", "b"], [""], None]
    assert [r.g for r in got] == ["python", "other", "other"]


def test_proximity_and_braces(spark):
    code = "a.decode(x)\n1\n2\nb.execute(y)\n" + "\n" * 9 + "c.execute(z)"
    df = spark.createDataFrame([(1, code), (2, None)], "id int, code string")
    assert [(r.line, r.gap) for r in signals.near(df, "id", "code", "\\.execute\\(", "\\.decode\\(").collect()] == [(4, 3)]
    js = spark.createDataFrame([(1, "function f() {\n if (a) {\n }\n}\nrest"), (2, "x {")], "id int, code string")
    assert {r.id: (r.block_lines, r.closed) for r in chunks.brace_blocks(js, "id", "code").collect()} == {1: (4, True), 2: (1, False)}


def test_syntax_trees(spark):
    code = (
        "import os\nclass Box:\n    def is_valid(self, value):\n        if value.startswith('x'):\n            return value.split('-')[0] == 'x'\n"
        "        def inner(s):\n            return s\n        return False\ndef run(data):\n    return os.path.join('a', data)\n"
    )
    df = spark.createDataFrame([(1, code), (2, "def ("), (3, None), (4, "")], "id int, code string")
    got = {(r.id, r.name): r for r in syntax.python_functions(df, "id", "code").collect()}
    assert set(got) == {(1, "Box.is_valid"), (1, "run"), (2, None)}
    assert got[1, "Box.is_valid"].calls == ["split", "startswith"] and got[1, "run"].calls == ["join"]
    assert got[1, "Box.is_valid"].intent and not got[1, "run"].intent
    assert got[2, None].error == "SyntaxError"


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "src/b.txt").write_text("no")
    (tmp_path / "node_modules/c.js").write_text("no")
    got = files.source_files(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.language, r.text) for r in got] == [("a.py", "python", "x = 1")]
    (tmp_path / "r.jsonl").write_text(json.dumps({"a": 1}) + "\n\nnot json\n" + json.dumps({"a": 2}) + "\n")
    good, bad = files.json_lines(spark, str(tmp_path / "r.jsonl"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.value for r in bad.collect()] == ["not json"]


def test_split_outputs_partition_the_input(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean")
    files.write_split(df, F.col("ok"), str(tmp_path))
    parts = [spark.read.json(f"{tmp_path}/{p}").count() for p in ("survivors", "rejected")]
    assert parts == [1, 2]


def test_syntax_scores_chunks_and_scripts(spark):
    long_method = "class Box:\n    def is_valid(self, value):\n" + "        value = value.strip()\n" * 6 + "        return value.startswith('x')\n"
    many = "".join(f"import module_{i:02d}\n" for i in range(20)) + "import socket\n"
    df = spark.createDataFrame([(1, "import os\n" + long_method), (2, many), (3, "import box.core\nx = 1"), (4, "def f(:"), (5, None)], "id long, code string")
    trees = syntax.python_functions(df, "id", "code")
    box = trees.where("id = 1").first()
    assert (box.score, box.intent, box.decides, box.parses, box.takes_input) == (7.5 - 0.5 + 0.0 + 0.5, True, True, True, True)
    both = {(r.kind, r.name, r.context) for r in syntax.chunks(trees, twice=True).collect()}
    assert both == {("method", "Box.is_valid", "os\n\n" + "\n".join(long_method.split("\n")[:8])), ("function", "is_valid", "os")}
    scripts = {r.id: r for r in syntax.vetted(syntax.python_scripts(df, "id", "code"), ["socket"]).collect()}
    assert {i: r.blocked for i, r in scripts.items()} == {1: False, 2: True, 3: False, 4: True} and len(scripts[2].imports) == 21


def test_sinks_blocks_and_hints(spark):
    from quarrylens import dims
    from quarrylens.operators import static

    code = "x = 1\n" * 7 + "os.system(cmd)\nmyos.system(cmd)\ntheir.system(cmd)\ncursor.execute(q)\n"
    df = spark.createDataFrame([(1, code), (2, ""), (3, None), (4, "y = 2")], "id int, code string")
    hits = {(r.vuln_type, r.sink_name, r.line) for r in static.match_sinks(static.line_calls(df, "id", "code"), dims.PY_SINKS).collect()}
    assert hits == {("RCE", "os.system", 8), ("RCE", "os.system", 9), ("SQLI", "execute", 11)}
    js = spark.createDataFrame([(1, "function login(a) {\n  if (a) {\n    eval(a)\n  }\n}\nconst f = (b) => b\n")], "id int, code string")
    got = [(r.name, r.start_line, r.end_line) for r in static.brace_functions(js, "id", "code", dims.JS_FUNCTION).orderBy("start_line").collect()]
    assert got == [("login", 1, 5), ("if", 2, 4), ("f", 6, 6)]
    secret = static.pattern_hits(spark.createDataFrame([(1, "a\nSECRET = 'abcdef'\n")], "id int, code string"), "id", "code", dims.JS_SINKS).collect()
    assert [(r.vuln_type, r.line, r.match) for r in secret] == [("HARDCODED_SECRET", 2, "SECRET = 'abcdef'")]


def test_report_documents_hold_every_finding_once(spark, sf_dir):
    from quarrylens.operators import emit
    from quarrylens.session import table

    v = table(spark, sf_dir, "vulns")
    ids = [r["properties"]["vuln_id"] for d in emit.documents(v, 100).collect() for r in json.loads(d.document)["runs"][0]["results"]]
    assert sorted(ids) == sorted(r.vuln_id for r in v.select("vuln_id").collect())


def test_stored_lists_graphs_and_contracts(spark, tmp_path):
    import pytest

    one = spark.createDataFrame([(i, f"v{i}") for i in range(15)], "n int, v string")
    files.append_rows(one, str(tmp_path / "list"))
    files.append_rows(one.withColumn("n", F.col("n") + 15), str(tmp_path / "list"))
    (tmp_path / "list" / "part-broken.json").write_text("{broken\n")
    assert [r.n for r in files.last_rows(spark, str(tmp_path / "list"), "n int, v string", "n").collect()] == list(range(29, 9, -1))
    edges = spark.createDataFrame([(1, "a"), (1, "a"), (1, ""), (2, "b")], "caller_id long, callee_name string")
    nodes = spark.createDataFrame([(1, "x")], "id long, name string")
    files.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 2
    assert files.conforming(edges.withColumn("extra", F.lit(1)), "edges").columns == ["caller_id", "callee_name"]
    with pytest.raises(ValueError, match="nodes lacks repo"):
        files.conforming(nodes, "nodes")
