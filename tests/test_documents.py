"""Readers, JSON forms and audits on small cases."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from cairnset import session
from cairnset.functions import jsontext
from cairnset.operators import audits
from cairnset.sources import documents, findings, loader


def test_json_forms_equal_the_json_module(spark):
    values = [{"b": [1, {"z": None, "a": "é\n"}], "a": 1.5}, [], "x", 7, None]
    texts = [json.dumps(v) for v in values] + ["{bad", "", None, '{"a": 1} x']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = [tuple(r) for r in df.select(jsontext.canonical_json(F.col("t")), jsontext.pretty_json(F.col("t"))).collect()]
    assert got == [(json.dumps(v, sort_keys=True, separators=(",", ":")), json.dumps(v, sort_keys=True, indent=2)) for v in values] + [(None, None)] * 4


REPORT = json.dumps({"version": "2.1.0", "runs": [{"results": [{"ruleId": "r", "message": {"text": "m"}}]}]})
FEED = json.dumps({"signature": "codex-security/1", "title": "t", "cwe": ["CWE-1", "CWE-2"], "code_paths": ["a.py:1"]}) + "\n\n" + json.dumps({"finding_id": "f", "cwe": "x"}) + "\n"


def test_one_loader_for_every_format(spark):
    found = json.dumps({"documentType": "d", "findings": [{"findingId": "k", "summary": "s"}]})
    files = spark.createDataFrame([("r", REPORT, 1), ("f", FEED, 1), ("d", found, 1), ("t", "# A note\nsee x.py", 1), ("e", " \n", 1), ("n", None, 1)], "file string, text string, format int")
    rows = {(r.file, r.place): r for r in loader.load_claims(files.select("file", "text")).collect()}
    assert set(rows) == {("r", 0), ("f", 1), ("f", 3), ("d", None), ("t", 0)}
    first, second = rows["f", 1], rows["f", 3]
    assert (first.claim_id, first.tool, first.weakness, first.locators) == ("codex-security/1", "Codex Security", "CWE-1, CWE-2", ["a.py:1"])
    assert (second.claim_id, second.tool, second.weakness, second.locators) == ("f", "Mantis", "x", [])
    assert first.raw_text == json.dumps(json.loads(FEED.splitlines()[0]), indent=2, sort_keys=True)
    assert rows["t", 0].locators == [] and rows["t", 0].severity is None and rows["t", 0].title == "A note"


def test_what_cannot_be_read_is_named(spark):
    spread = '{"signature":\n"x"}'
    files = spark.createDataFrame([("a", FEED), ("b", spread), ("c", '{"x": 1}'), ("d", '{"x": ')], "file string, text string")
    known = loader.sniffed(files)
    assert sorted((r.file, r.line_no) for r in loader.problems(known).orderBy("file").collect() if r.line_no) == [("b", 1), ("b", 2)]
    assert {r.file for r in loader.problems(known).collect()} == {"b", "c", "d"}
    with pytest.raises(ValueError, match="b:1: not a JSON object"):
        loader.load_claims(files)
    assert loader.load_claims(files.where("file = 'none'")).count() == 0


def test_documents(spark):
    at = datetime.datetime(2026, 3, 4, 5, 6, 7, 890)
    entries = [{"identity": {"key": "k"}, "title": "old", "anchors": None}, {"identity": {"key": "k"}, "title": "new", "anchors": [{"locator": "a:1", "sha256": None}, 3]}, {"title": "keyless"}, 5]
    one = spark.createDataFrame([(1, json.dumps({"format": "f-1", "entries": entries}))], "i int, doc string")
    tables = documents.tables_of(one, "i", "doc", documents.BASELINE, "f-1")
    assert [(r.label, r.title) for r in tables["entries"].orderBy("label").collect()] == [([0], "old"), ([1], "new"), ([2], "keyless"), ([3], None)]
    assert [(r.parent_label, r.locator) for r in tables["anchors"].orderBy("label").collect()] == [([1], "a:1"), ([1], None)]
    assert [(r.identity_key, r.title) for r in documents.baseline_entries(one, "i", "doc").collect()] == [("k", "new")]
    with pytest.raises(Exception, match="1 is not of format f-2"):
        documents.tables_of(one, "i", "doc", documents.BASELINE, "f-2")["entries"].collect()
    record = {"claim": {"claim_id": "c"}, "extra": {"x": [1]}, "assessment": {"candidates": [{"justification": "j"}]}}
    listed = spark.createDataFrame([(1, json.dumps([record]))], "i int, doc string")
    row = documents.records_with_text(listed, "i", "doc").first()
    assert row.claim_id == "c" and json.loads(row.raw) == record
    manifest = {"artifacts": [{"role": "r", "path": "p", "size": 3, "sha256": None}], "quoted_spans": [{"locator": "a:1", "truncated": True}]}
    made = documents.tables_of(spark.createDataFrame([(1, json.dumps(manifest))], "i int, doc string"), "i", "doc", documents.MANIFEST)
    assert [(r.role, r["size"], r.sha256) for r in made["artifacts"].collect()] == [("r", 3, None)] and made["quoted_spans"].first().truncated
    lines = [(1, '{"request_hash": "h", "model": "m1"}'), (2, " "), (3, '{"request_hash": "h", "model": "m2"}'), (4, "{bad"), (5, '{"model": "m"}')]
    read = documents.recordings(spark.createDataFrame(lines, "n int, line string"), "n", "line").collect()
    assert [(r.request_hash, r.n, r.model) for r in read] == [("h", 3, "m2")]
    times = spark.createDataFrame([(0, at)], "i int, at timestamp_ntz").select(documents.iso_text(F.col("at")).alias("t"))
    assert times.first().t == "2026-03-04T05:06:07.000890+00:00"
    back = spark.createDataFrame([(0, "2026-03-04T05:06:07.000890+00:00"), (1, "2026-03-04T05:06:07Z"), (2, "soon"), (3, None)], "i int, t string")
    got = [r[0] for r in back.orderBy("i").select(documents.iso_time(F.col("t")).cast("timestamp_ntz")).collect()]
    assert got == [at, at.replace(microsecond=0), None, None]


def test_rows_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", 1), ("c", 2)], "title string, n int")
    documents.write_rows(df, str(tmp_path / "out"), "title")
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"title":"a","n":1}', '{"title":"b","n":null}', '{"title":"c","n":2}']


CODE = """
from enum import StrEnum
class Color(StrEnum):
    RED = "r"
    BLUE = "b"
    small = "s"
class LostError(Exception): pass
class MetError(Exception): pass
class Plain: pass
def f():
    use(Color.RED)
    raise MetError("x")
"""
TESTS = """
import pytest
def test_literal(): assert 1 == 1
def test_empty(): pass
def test_call(): run()
def test_name(): assert x
def test_raises():
    with pytest.raises(LostError): pass
def helper(): pass
async def test_late():
    assert True
    Color.BLUE
    raise LostError()
"""


def test_audits(spark, monkeypatch):
    files = spark.createDataFrame([("a.py", CODE, False, 0), ("t.py", TESTS, True, 0), ("bad.py", "def (", False, 0), ("n.py", None, False, 0)], "path string, text string, in_test boolean, kind int")
    rows = audits.findings(audits.file_facts(files)).cache()
    assert sorted((r.kind, r.name, r.path) for r in rows.collect()) == [
        ("never_raised", "LostError", "a.py"), ("test_cannot_fail", "test_empty", "t.py"), ("test_cannot_fail", "test_late", "t.py"),
        ("test_cannot_fail", "test_literal", "t.py"), ("unused_member", "Color.BLUE", "a.py"),
    ]
    assert {r.kind: r.n for r in audits.by_kind(rows).collect()} == {"never_raised": 1, "test_cannot_fail": 3, "unused_member": 1}
    assert audits.findings(audits.file_facts(files.limit(0))).count() == 0
    monkeypatch.setattr(audits, "LARGEST_FILE", 10)
    assert [r.kind for r in audits.file_facts(files.where("path = 'a.py'")).collect()] == ["too_large"]


def test_source_files_keep_their_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(findings, "LARGEST_FILE", 30)
    (tmp_path / "pkg").mkdir()
    for name, content in (("a.py", b"x = 1\n"), ("b.py", b"\xff\xfe"), ("c.py", b"# " + b"y" * 40)):
        (tmp_path / "pkg" / name).write_bytes(content)
    got = {r.path: (r.text, r.state) for r in findings.source_tree(spark, str(tmp_path)).collect()}
    assert got == {"pkg/a.py": ("x = 1\n", "text"), "pkg/b.py": (None, "not_utf8"), "pkg/c.py": (None, "too_large")}


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        class _jsc:
            @staticmethod
            def sc():
                return type("C", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()

        @staticmethod
        def getConf():
            return {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(type("S", (), {"sparkContext": Context})())
    assert session.run_folder(spark).startswith(session.shared_dir(spark))
