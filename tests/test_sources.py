import json

import pytest

from siftline.functions import versions as vs
from siftline.plans import source_queries
from siftline.sources import manifests, reports


def _docs(spark, *values):
    return spark.createDataFrame([(json.dumps(v) if not isinstance(v, str) else v,) for v in values], "value string")


def test_pattern_matches(spark):
    doc = {"results": [{"check_id": "pack.query-built-by-hand", "path": "app.py", "start": {"line": 10, "col": 1}, "end": {"line": 11, "col": 2}, "extra": {"message": "m", "severity": "ERROR", "metadata": {"category": "security", "cwe": ["CWE-89: SQL"], "confidence": "HIGH"}}}]}
    row = reports.pattern_matches(_docs(spark, doc, "not json")).collect()
    assert len(row) == 1
    assert (row[0].severity, row[0].type, row[0].confidence, row[0].cwe, row[0].end_line) == ("high", "vulnerability", 0.9, "CWE-89", 11)


def _place(uri, line):
    return {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line}}}


def test_sarif_flows(spark):
    flow = [{"threadFlows": [{"locations": [{"location": _place("inbox/read.py", 5)}, {"location": _place("store/write.py", 20)}]}]}]
    doc = {"runs": [{"results": [{"ruleId": "r1", "level": "error", "locations": [_place("file://a.py", 3)], "codeFlows": flow}, {"ruleId": "r2", "level": "note", "locations": [_place("b.py", 4)]}]}]}
    one, two = reports.sarif_results(_docs(spark, doc)).orderBy("rule_id").collect()
    assert one.complete and [(s.step, s.file, s.line) for s in one.steps] == [(1, "inbox/read.py", 5), (2, "store/write.py", 20)]
    assert not two.complete and len(two.steps) == 1 and two.severity == "low" and one.file == "a.py"


def test_feeds(spark):
    kev = {"vulnerabilities": [{"cveID": "CVE-1", "vendorProject": "v", "product": "p", "dateAdded": "2024-01-02", "knownRansomwareCampaignUse": "Known"}]}
    row = reports.exploited_catalogue(_docs(spark, kev)).first()
    assert row.ransomware and str(row.added) == "2024-01-02"
    osv = {"id": "GHSA-1", "aliases": ["X", "CVE-2024-1"], "affected": [{"ranges": [{"events": [{"introduced": "1.0.0"}, {"fixed": "1.2.0"}]}]}]}
    row = reports.advisories(_docs(spark, osv)).first()
    assert row.cve_id == "CVE-2024-1" and row.ranges == [">=1.0.0", "<1.2.0"]
    table = spark.createDataFrame([("1", "CVE-2020-1234;cve-2020-1234;OSVDB-1", "webapps", "2020-02-03")], "id string, codes string, type string, date string")
    row = reports.exploit_rows(table).first()
    assert row.cve_ids == ["CVE-2020-1234"] and row.poc_type == "webapp"


@pytest.mark.parametrize(
    ("version", "ranges", "patched", "expected"),
    [
        ("1.5.0", [">=1.0.0,<2.0.0"], None, True),
        ("2.0.0", [">=1.0.0,<2.0.0"], None, False),
        ("3.0.0", [">=1.0.0", "<2.0.0"], None, True),
        ("1.5.0", [">=1.0.0"], ["1.4.0"], False),
        ("1.0.0-alpha", ["1.0.0"], None, True),
        ("0.5.0", [">=0"], None, False),
    ],
)
def test_version_ranges(spark, version, ranges, patched, expected):
    df = spark.createDataFrame([(version, ranges, patched)], "version string, ranges array<string>, patched array<string>")
    from pyspark.sql import functions as F

    assert df.select(vs.affected(F.col("version"), F.col("ranges"), F.col("patched"))).first()[0] is expected


def test_manifests(spark):
    files = lambda text: spark.createDataFrame([("f", text)], "path string, content string")
    rows = manifests.requirements(files("# c\nFlask_Login[x,y]>=1.0 ; python_version > '3'\n-r other\nrequests==2.0  # pin\nplain\n")).collect()
    assert [(r.name, r.operator, r.version) for r in rows] == [("flask-login", ">=", "1.0"), ("requests", "==", "2.0"), ("plain", None, None)]
    rows = manifests.npm_manifest(files('{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}')).collect()
    assert sorted((r.name, r.is_dev) for r in rows) == [("a", False), ("b", True)]
    sums = spark.createDataFrame([("github.com/x/y", "v1.1.0")], "name string, version string")
    rows = manifests.go_modules(files("module m\nrequire (\n\tgithub.com/x/y v1.0.0\n\tgolang.org/x/z v0.1.0 // indirect\n)"), sums).collect()
    assert sorted((r.name, r.version, r.is_direct, r.confidence) for r in rows) == [("github.com/x/y", "v1.1.0", True, 1.0), ("golang.org/x/z", "v0.1.0", False, 0.5)]
    pom = "<project><properties><lib.version>3.2</lib.version></properties><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${lib.version}</version></dependency></project>"
    assert [(r.name, r.version) for r in manifests.maven(files(pom)).collect()] == [("g:a", "3.2")]


def test_git_changes(spark):
    lines = [":100644 100644 abc def M\ta.py", ":100644 100644 abc def R087\told.py\tnew.py", "3\t1\ta.py", "-\t-\tnew.py"]
    rows = {r.path: r for r in manifests.git_changes(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert (rows["a.py"].change, rows["a.py"].additions) == ("modified", 3)
    assert (rows["new.py"].change, rows["new.py"].old_path, rows["new.py"].deletions) == ("renamed", "old.py", 0)


def test_health_is_read_from_the_whole_text(spark, tmp_path):
    late = "a long line of other output, and then at last: permission denied"
    spark.createDataFrame([(2, late), (3, "all went well, as it should")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = source_queries.QUERIES["exp29_health_classes"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.health) for r in out) == [(2, "permission"), (3, "ok")]
