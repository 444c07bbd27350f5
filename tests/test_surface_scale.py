import pytest
from pyspark.sql import functions as F

from siftline.functions.text import running_total
from siftline.sources import surface


def test_long_runs_of_decorators_and_many_matches(spark):
    tall = "@app.route('/x')\n" + "@other\n" * 100_000 + "def f():\n  pass\n"
    many = "".join(f"@app.get('/r{k}')\ndef h{k}():\n\n" for k in range(3000))
    out = surface.entry_points(spark.createDataFrame([("a.py", tall), ("b.py", many), ("c.py", None)], "path string, content string")).collect()
    assert sorted((r.path, r.line, r.route, r.handler) for r in out if r.path == "a.py") == [("a.py", 1, "/x", "f")]
    assert sorted((r.line, r.route, r.handler) for r in out if r.path == "b.py") == sorted((3 * k + 1, f"/r{k}", f"h{k}") for k in range(3000))


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10, 1000])
def test_running_totals(spark, n):
    values = [(k * 7) % 5 for k in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>").select(running_total(F.col("v")).alias("r")).first()
    assert row.r == [sum(values[:k]) for k in range(n)]


def test_workflow_rules(spark):
    text = "\n".join(
        [
            "on: pull_request_target",
            "  uses: actions/checkout@v4",
            "  DB_PASSWORD: 'abcdefghijkl'",
            '  - api_key: "${{ secrets.KEY }}"',
            "  note: 'abcdefghijkl'",
            "  run: echo ${{ github.event.pull_request.head.ref }}",
            "  run: echo ${{ toJSON(github.head_ref) }}",
            "  run: echo ${{ github.event.pull_request.number }}",
            "  TOKEN: 'short'",
        ]
    )
    files = spark.createDataFrame([(".github/workflows/x.yml", text)], "path string, content string")
    assert {(r.line, r.rule) for r in surface.config_risks(files).collect()} == {(1, "target_checkout"), (3, "plain_secret"), (6, "untrusted_input"), (7, "untrusted_input")}
