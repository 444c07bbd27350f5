import json

import pytest
from pyspark.sql import functions as F

from siftline.functions import jsonfix, text
from siftline.sources import structure, surface


@pytest.mark.parametrize(
    ("broken", "want"),
    [
        ('{"a": 1}', {"a": 1}),
        ('say:\n```json\n{"a": [1, 2]}\n```\nbye', {"a": [1, 2]}),
        ('text {"a": 1,} more', {"a": 1}),
        ('｛"a"： “x”，"b": 2｝', {"a": "x", "b": 2}),
        ("{'a': 'it', b: True, /* c */ \"n\": None}", {"a": "it", "b": True, "n": None}),
        ('{"a": 1, // note\n "b": [1, 2', {"a": 1, "b": [1, 2]}),
        ('{"a": "line\nbreak"}', {"a": "line\nbreak"}),
        ("no json at all", None),
        (None, None),
    ],
)
def test_json_repair(spark, broken, want):
    got = spark.createDataFrame([(broken,)], "t string").select(jsonfix.repaired(F.col("t"))).first()[0]
    assert (got and json.loads(got)) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [(None, ""), ('  exec( "ls -l" )  ', "exec( 'x' )"), ("a\\b  ${USER}/$HOME", "a/b $x/$x"), ("{{ name }} {{name}}", "{{ name }} {{x}}"), ("X\n\tY", "x y")],
)
def test_normalize_code(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(text.normalize_code(F.col("t"))).first()[0] == want


def test_paths_functions_and_windows(spark):
    df = spark.createDataFrame([(".//./Src\\A.py", " Self.run", "l1\nl2\nl3\nl4", 1)], "p string, f string, t string, n int")
    row = df.select(text.normalize_path(F.col("p")), text.normalize_function(F.col("f")), text.line_window(F.col("t"), F.col("n"), 1), text.route_path(F.lit("/u/:id/<int:k>"))).first()
    assert tuple(row) == ("src/a.py", "run", "l1\nl2", "/u/{id}/{k}")


SOURCE = '''
import os
from a.b import c as d

class K:
    def run(self):
        helper()
        os.system("x")

@app.route("/run")
def entry():
    K().run()
    missing()

def helper():
    pass
'''


def test_structure_and_call_graph(spark):
    files = spark.createDataFrame([("m.py", SOURCE), ("n.py", "def other():\n    entry()\n"), ("bad.py", "def ("), ("none.py", None)], "path string, content string")
    s = structure.python_structure(files)
    rows = {(r.path, r.kind, r.name) for r in s.collect()}
    assert {("m.py", "function", "K.run"), ("m.py", "class", "K"), ("m.py", "import", "os"), ("m.py", "import", "a.b.c"), ("bad.py", "error", "SyntaxError")} <= rows
    nodes, edges = structure.call_graph(s)
    assert {r.id for r in nodes.where("is_entry").collect()} == {"m.py:entry"}
    assert {(r.src, r.dst) for r in edges.collect()} == {("m.py:K.run", "m.py:helper"), ("m.py:entry", "m.py:K.run"), ("n.py:other", "m.py:entry")}


def test_routes_and_config_rules(spark):
    code = '@app.route("/a/<int:id>")\nr.GET("/b/:name", h)\n@app.post(\'/c\')\n@GetMapping("/d")\nplain()\n'
    docker = "FROM x:latest\nUSER root\nRUN curl http://a | sh\nENV API_KEY=1\n"
    flow = "steps:\n  - uses: a/b@main\n  - run: echo ${{ github.event.issue.title }}\n"
    files = spark.createDataFrame([("s.py", code), ("Dockerfile", docker), (".github/workflows/ci.yml", flow)], "path string, content string")
    got = sorted((r.line, r.framework, r.method, r.route) for r in structure.routes(files).where("path = 's.py'").collect())
    assert got == [(1, "flask", "ANY", "/a/{id}"), (2, "gin", "GET", "/b/{name}"), (3, "fastapi", "POST", "/c"), (4, "spring", "GET", "/d")]
    found = {(r.path, r.line, r.rule) for r in surface.config_risks(files).collect()}
    assert found == {("Dockerfile", 1, "DF008"), ("Dockerfile", 2, "DF001"), ("Dockerfile", 3, "DF007"), ("Dockerfile", 4, "DF005"), (".github/workflows/ci.yml", 2, "unpinned_action"), (".github/workflows/ci.yml", 3, "untrusted_input")}
