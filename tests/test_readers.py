"""Finding readers on literals, a source tree on disk, and snapshots arriving as a stream."""

import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from cairnset.sources import findings
from cairnset.streaming.changes import keep_newest

REPORT = {
    "version": "2.1.0",
    "runs": [
        {
            "tool": {"driver": {"name": "scan", "version": 3}},
            "results": [
                {"ruleId": "R1", "level": "error", "message": {"text": "first\nsecond"}, "locations": [
                    {"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 3, "endLine": 9}}},
                    {"physicalLocation": {"artifactLocation": {"uri": "b.py"}, "region": {"startLine": 4, "endLine": 4}}},
                    {"physicalLocation": {"artifactLocation": {"uri": "c.py"}}}, {}]},
                {"ruleId": "R2"},
                7,
            ],
        }
    ],
}


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "report_id long, payload string")


def test_formats(spark):
    cases = [
        (None, "empty"), (" \n", "empty"), ("# Title", "text"), (json.dumps(REPORT), "sarif"), ('{"$schema": 1}', "sarif"), ('{"version": 1}', "unknown"),
        ('{"findings": [], "documentType": "x"}', "findings"), ('{"signature": "s"}', "feed"), ('{"a": 1}\n\n{"b": 2}\n', "feed"), ('{"a": 1}\nx', "unknown"), ('{"a"', "unknown"), ("[1]", "text"),
    ]
    df = frame(spark, *[c for c, _ in cases])
    assert [r[0] for r in df.orderBy("report_id").select(findings.sniff(F.col("payload"))).collect()] == [w for _, w in cases]


def test_reports(spark):
    got = findings.report_claims(frame(spark, json.dumps(REPORT), "{}", None)).orderBy("result_no").collect()
    assert [(r.title, r.weakness, r.severity, r.tool, r.tool_version, r.locators) for r in got] == [
        ("first", "R1", "error", "scan", None, ["a.py:3-9", "b.py:4", "c.py"]),
        ("R2", "R2", None, "scan", None, []),
    ]
    assert got[0].claim_id.startswith("sarif-") and len(got[0].claim_id) == 22


def test_feed_rows(spark):
    lines = ['{"signature": "s1", "cwe": ["CWE-1", "CWE-2", 3], "code_paths": ["a:1", null], "title": 5}', '{"finding_id": "f", "cwe": "CWE-9"}', '{"x": 1}', "[]", "bad", None]
    got = findings.feed_claims(frame(spark, *lines), "report_id", "payload").orderBy("report_id").collect()
    assert [(r.claim_id[:5], r.title, r.weakness, r.locators) for r in got] == [
        ("s1", "", "CWE-1, CWE-2", ["a:1"]), ("f", "", "CWE-9", []), ("feed-", "", None, []),
    ]


def test_findings_documents(spark):
    doc = {"documentType": "d", "findings": [
        {"findingId": "i1", "ruleId": "R", "summary": "one\ntwo", "identity": {"cwe": "CWE-5"}, "severity": {"level": "high"},
         "locations": [{"path": "p.py", "startLine": 2, "endLine": 5}, {"path": "q.py"}, {}]},
        {"ruleId": "R", "severity": "low"}, None]}
    got = findings.findings_claims(frame(spark, json.dumps(doc)), "report_id", "payload").collect()
    assert sorted((r.title, r.weakness, r.severity, r.locators) for r in got) == [("", "R", "low", []), ("one", "CWE-5", "high", ["p.py:2-5", "q.py"])]


def test_texts(spark):
    got = findings.text_claims(frame(spark, "\n  \n## Head line\nx", None, " ", "plain"), "report_id", "payload").orderBy("report_id").collect()
    assert [(r.report_id, r.title) for r in got] == [(0, "Head line"), (3, "plain")]


def test_source_tree(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-"))
    for name, content in (("a.py", b"x = 1\n"), ("pkg/b.py", b"\xff\xfe"), (".venv/c.py", b"1"), ("n.txt", b"1"), ("big.py", b"#" * 1_000_001)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    got = {r.path: r.text for r in findings.source_tree(spark, str(root)).collect()}
    assert got == {"a.py": "x = 1\n", "pkg/b.py": None, "big.py": None}


def test_stream_keeps_the_newest_row(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    schema = "k string, o long, v string"
    for rows in ([("a", 1, "x"), ("b", 1, "y"), (None, 9, "z")], [("a", 3, "new"), ("b", 0, "late")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        keep_newest(stream, ["k"], "o", f"{root}/out", f"{root}/check").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{root}/out/state/1").collect())) == [("a", 3, "new"), ("b", 1, "y")]
    assert [tuple(r) for r in spark.read.parquet(f"{root}/out/changed/1").collect()] == [("a", 3, "new")]
