import json

from pyspark.sql import functions as F

from siftline.functions.jsonfix import repaired
from siftline.operators import files as fl
from siftline.sources import feeds


def _docs(spark, *values):
    return spark.createDataFrame([(json.dumps(v),) for v in values], "value string")


def test_nvd(spark):
    cpe = "cpe:2.3:a:acme:tool:1.0:*"
    doc = {
        "id": "CVE-2024-1",
        "published": "2024-01-02T03:04:05.000",
        "descriptions": [{"lang": "es", "value": "no"}, {"lang": "en", "value": "text"}],
        "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 9.1}}], "cvssMetricV2": [{"cvssData": {"baseScore": 5.0}}]},
        "weaknesses": [{"description": [{"lang": "en", "value": "CWE-79"}, {"lang": "en", "value": "NVD-CWE-noinfo"}]}, {"description": [{"lang": "en", "value": "CWE-79"}]}],
        "configurations": [{"nodes": [{"cpeMatch": [{"criteria": cpe}, {"criteria": cpe}]}]}],
        "references": [{"url": "u1", "tags": ["Patch"]}, {"url": "u2", "tags": []}],
    }
    row = feeds.nvd_records(_docs(spark, doc, {"x": 1})).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.description, r.cvss_v3, r.cvss_v2, r.severity, r.cwe_ids, r.products, r.patches) == ("text", 9.1, 5.0, "critical", ["CWE-79"], ["acme:tool"], ["u1"])


def test_advisories_and_search(spark):
    doc = {"ghsa_id": "GHSA-1", "cve_id": None, "severity": "HIGH", "vulnerabilities": [{"package": {"ecosystem": "pip", "name": "x"}, "vulnerable_version_range": ">= 1.0, < 2.0"}]}
    r = feeds.github_advisories(_docs(spark, doc)).first()
    assert (r.cve_id, r.severity, r.products, r.ranges) == ("GHSA-1", "high", ["x"], [">=1.0,<2.0"])
    go = spark.createDataFrame([("1", "a/b"), ("2", "a/b/c"), ("3", "a/bc")], "id string, module string")
    assert [x.id for x in feeds.go_modules_affected(go, "a/b").collect()] == ["1", "2"]
    repos = spark.createDataFrame([("CVE-2024-1234-poc", "Rapid7", None, 3), ("tool", "x", "an exploit", 150), ("tool", "x", "nothing", 500), ("poc", "x", None, 0)], "name string, owner string, description string, stars int")
    got = sorted((r.stars, r.verified, len(r.cve_ids)) for r in feeds.poc_repositories(repos).collect())
    assert got == [(3, True, 1), (150, True, 0)]
    hits = lambda n: spark.createDataFrame([(f"t CVE-2020-000{k}", f"u{k}{n}", "cwe-79", k / 10) for k in range(5)], "title string, url string, snippet string, relevance double")
    out = feeds.search_union({"a": hits("a"), "b": hits("b")}, 2).collect()
    assert [r.relevance for r in out] == [0.4, 0.4, 0.3, 0.3] and out[0].cve_ids == ["CVE-2020-0004"] and out[0].cwe_ids == ["CWE-79"]


def test_model_replies(spark):
    reply = '```json\n{"findings": [{"title": "t", "severity": "HIGH", "line": 7,}], "suspicious_code": [{"location": "b.py:9", "why_suspicious": "w"}]}\n```'
    rows = feeds.model_findings(spark.createDataFrame([("a.py", reply), ("c.py", "sorry")], "file string, reply string")).collect()
    assert sorted((r.file, r.line, r.severity) for r in rows) == [("a.py", 7, "high"), ("b.py", 9, "low")]


def test_a_reply_is_parsed_once(spark):
    replies = ['{"findings": [null, {"title": "t"}], "suspicious_code": [{"location": "b.py", "why_suspicious": "w", "confidence": 0.5}]}', "so: {'suspicious_code': [{'location': 'b.py:9'", "[1]", "sorry", None]
    df = spark.createDataFrame([(f"{k}.py", r) for k, r in enumerate(replies)], "file string, reply string")
    out = feeds.model_findings(df)
    rows = sorted(map(tuple, out.collect()), key=str)
    assert rows == sorted([("0.py", 1, "medium", None, None, None), ("0.py", 1, "medium", "t", None, None), ("0.py", 1, "low", "w", None, 0.5), ("b.py", 9, "low", None, None, None)], key=str)
    plan = out.where("line = 9")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("_scanned(") == 1 and plan.count("parseJson(") <= 6
    assert [tuple(r)[:2] for r in out.where("line = 9").collect()] == [("b.py", 9)]
    # a filter on a repaired text is one on what Python makes of it
    fixed = df.select("file", repaired(F.col("reply")).alias("json")).where("json is not null and file < '3'")
    assert sorted(r.file for r in fixed.collect()) == ["0.py", "1.py", "2.py"]


def test_files(spark):
    df = spark.createDataFrame([("a/app.py", 1, 10, "python", 0), ("a/z.py", 1, 10, "python", 1), ("tests/t.py", 1, 5, "python", 2), ("static/s.js", 1, 5, "javascript", 3)], "path string, mtime int, size int, language string, input_seq int")
    one, two = fl.source_hash(df).first(), fl.source_hash(df.repartition(3).orderBy("size")).first()
    assert one == two and one.files == 4 and fl.source_hash(df.withColumn("size", F.col("size") + 1)).first().source_hash != one.source_hash
    assert [r.path for r in fl.kept_files(df, ["python", "javascript"], 0).orderBy("path").collect()] == ["a/app.py", "a/z.py", "static/s.js"]
    assert [r.path for r in fl.prioritised(df.orderBy(F.desc("input_seq")), 2).collect()] == ["a/app.py", "a/z.py"]
    rules = spark.createDataFrame([("exec($X)", False, False), ("eval", False, False), ("eval", True, False)], "p string, e boolean, i boolean")
    assert [r[0] for r in rules.select(fl.rule_validity(F.col("p"), F.col("e"), F.col("i"))).collect()] == ["valid", "literal_only", "valid"]
    cache = spark.createDataFrame([("a", None), ("b", 5), ("c", 20)], "k string, expires_at int")
    assert [r.k for r in fl.live(cache, F.lit(10)).orderBy("k").collect()] == ["a", "c"]


def test_token_bucket_equals_a_plain_loop(spark):
    times = [0, 0, 0, 1, 1, 2, 9, 9, 9, 9]
    df = spark.createDataFrame([(1, float(t), k) for k, t in enumerate(times)], "user_id long, seconds double, event_id long")
    got = [r.allowed for r in fl.token_bucket(df, 1.0, 2).orderBy("event_id").collect()]
    left, last, want = 2.0, 0.0, []
    for t in times:
        left, last = min(2.0, left + (t - last)), t
        want.append(left >= 1)
        left -= left >= 1
    assert got == want
