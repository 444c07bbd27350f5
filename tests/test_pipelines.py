import pytest

from siftline.plans import pipelines as pl
from siftline.plans.bindings import view

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "id long, input_seq long, rule_id string, file string, line int, source string, severity string, exploitability string, confidence double, function string, sink string, cwe string, filtered_by string, suppressed boolean, type string"


def _finding(seq, source, severity, exploitability, line=10, file="test.py", rule="rule-001", **more):
    base = dict(id=seq, input_seq=seq, rule_id=rule, file=file, line=line, source=source, severity=severity, exploitability=exploitability, confidence=None, function="process_input", sink=None, cwe=None, filtered_by=None, suppressed=False, type="vulnerability")
    return tuple((base | more).values())


def test_full_scan_merges_across_engines(spark):
    rows = [
        _finding(1, "semgrep", "high", "exploitable"),
        _finding(2, "codeql", "high", "exploitable", line=12, file="./test.py"),
        _finding(3, "agent", "critical", "not_exploitable"),
        _finding(4, "semgrep", "critical", "unlikely", file="a.py", rule="rule-002"),
        _finding(5, "semgrep", "low", "exploitable", file="a.py", rule="rule-003"),
        _finding(6, "semgrep", "medium", None, file="a.py", rule="rule-004", filtered_by="rule_gating"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.rule_id: r for r in pl.full_scan(df).collect()}
    assert out["rule-001"].duplicate_count == 2 and out["rule-001"].related_engines == "agent,codeql,semgrep" and out["rule-001"].id == 2
    assert {k: r.report_status for k, r in out.items()} == {"rule-001": "exploitable", "rule-002": "conditional", "rule-003": "conditional", "rule-004": "suppressed"}
    verified = spark.createDataFrame([(1, "safe"), (2, "safe")], "id long, exploitability string")
    assert {r.rule_id: r.final_status for r in pl.full_scan(df, verified, "medium").collect()}["rule-001"] == "not_exploitable"
    assert "rule-003" not in {r.rule_id for r in pl.full_scan(df, minimum="medium").collect()}


@pytest.mark.parametrize(
    ("base", "now", "want"),
    [
        ([], [10], ["new"]),
        ([(10, False)], [10], ["persistent"]),
        ([(10, False)], [15], ["persistent"]),
        ([(10, False)], [16], ["fixed", "new"]),
        ([(10, True)], [10], ["regressed"]),
        ([(10, False)], [], ["fixed"]),
    ],
)
def test_baseline_cases(spark, base, now, want):
    from siftline.operators.dedup import baseline_diff

    baseline = spark.createDataFrame([(k, k, "rule-001", "test.py", line, fixed) for k, (line, fixed) in enumerate(base)], "baseline_seq long, vuln_id long, rule_id string, file string, line int, fixed boolean")
    current = spark.createDataFrame([(k, "rule-001", "test.py", line) for k, line in enumerate(now)], "input_seq long, rule_id string, file string, line int")
    assert sorted(r.status for r in baseline_diff(current, baseline).collect()) == want


def test_incremental_scan_keeps_to_the_impact(spark):
    changes = spark.createDataFrame([("a.py", "modified"), ("gone.py", "deleted")], "path string, change string")
    edges = spark.createDataFrame([("b.py", "a.py"), ("c.py", "b.py"), ("z.py", "y.py")], "src string, dst string")
    findings = spark.createDataFrame([(k, "r", f, 1) for k, f in enumerate(["a.py", "b.py", "c.py", "z.py"])], "input_seq long, rule_id string, file string, line int")
    baseline = spark.createDataFrame([(1, 1, "r", "gone.py", 1, False), (2, 2, "r", "z.py", 90, False)], "baseline_seq long, vuln_id long, rule_id string, file string, line int, fixed boolean")
    got = sorted((r.status, r.current_id, r.baseline_id) for r in pl.incremental_scan(changes, edges, findings, baseline).collect())
    assert got == [("fixed", None, 1), ("new", 0, None), ("new", 1, None), ("new", 2, None)]


def test_documents_to_report_and_back(spark, tmp_path):
    docs = spark.createDataFrame([('{"results": [{"check_id": "r", "path": "a.py", "start": {"line": 3}, "extra": {"severity": "ERROR", "message": "m"}}]}',)], "value string")
    found = pl.read_findings({"pattern": docs}, {"pattern": "semgrep"})
    assert found.first().source == "semgrep"
    report = pl.full_scan(view(spark, FOLDER, "findings"))
    pl.export_scan(report, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == report.count()
    lines = pl.markdown(report, 5).collect()
    assert len(lines) == 5 and lines[0].value.startswith("| ")
    for version in (1, 2):
        pl.save_snapshot(report.limit(version), str(tmp_path / "b"), version)
    assert pl.load_snapshot(spark, str(tmp_path / "b")).count() == 2 and pl.load_snapshot(spark, str(tmp_path / "b"), 1).count() == 1


def test_vulnerability_scan_and_plan(spark):
    deps = spark.createDataFrame([(1, "pip", "x", "1.5.0", 1.0), (2, "pip", "x", "2.5.0", 1.0), (3, "pip", "x", "1.0.0", 0.1)], "input_seq long, ecosystem string, name string, version string, version_confidence double")
    adv = spark.createDataFrame([("pip", "x", ">=1.0.0,<2.0.0", 7), ("pip", "x", ">=1.4.0,<1.6.0", 8)], "ecosystem string, name string, spec string, cve_id long")
    cves = spark.createDataFrame([(7, "high", False), (8, "critical", True)], "cve_id long, severity string, kev boolean")
    assert [tuple(r) for r in pl.vulnerability_scan(deps, adv, cves).collect()] == [(1, 2, True, "critical", "7,8")]
    plan = pl.audit_plan(view(spark, FOLDER, "targets")).collect()
    assert [r.score for r in plan] == sorted((r.score for r in plan), reverse=True)
