"""Nested reports: whole-document validity, single objects, positions and labels."""

import json

from pyspark.sql import functions as F

from cairnset.operators import nested

SCHEMA = "report_id long, payload string, label string, node int"


def reports(spark, *payloads):
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p), "x", 1) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, SCHEMA)


def found(spark, *payloads):
    return sorted(tuple(r) for r in nested.report_locations(reports(spark, *payloads)).collect())


def loc(uri, **region):
    return {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": region or None}}


def one(*locations, **more):
    return {"runs": [{"results": [{"locations": list(locations), **more}]}]}


def test_invalid_documents_give_nothing(spark):
    good = json.dumps(one(loc("a.py")))
    assert found(spark, None, "", " ", "null", "[1]", "7", good[:-1], good + "x", "<html>", '{"runs": null}', '{"runs": 5}') == []


def test_lines(spark):
    cases = [
        loc("a"), loc("a", startLine=3), loc("a", startLine="04", endLine=4), loc("a", startLine=3, endLine="9"), loc("a", startLine=0),
        loc("a", startLine=-1, endLine=3), loc("a", startLine=True), loc("a", startLine="x", endLine=4), loc("a", startLine=2.5),
        loc("a", startLine=5.0), loc("a", startLine=" 3"), loc("a", startLine=None, endLine=2), loc("a", startLine=[1]),
    ]
    got = [r[5] for r in found(spark, one(*cases))]
    assert got == ["a", "a:3", "a:4", "a:3-9", "a", "a", "a", "a", "a", "a:5", "a", "a", "a"]


def test_positions_count_elements_without_a_locator(spark):
    assert found(spark, one(None, 5, loc(" "), loc(None), loc(7), loc("\tb.py "), {})) == [(0, 0, 0, "locations", 5, "\tb.py ")]


def test_single_objects_are_arrays_of_one(spark):
    doc = {"runs": {"results": {"locations": loc("x"), "relatedLocations": loc("y"), "codeFlows": {"threadFlows": {"locations": {"location": loc("z")}}}}}}
    assert [r[3:] for r in found(spark, doc)] == [("codeFlows", 0, "z"), ("locations", 0, "x"), ("relatedLocations", 0, "y")]


def test_flow_positions_run_through_the_whole_result(spark):
    step = lambda u: {"location": loc(u)}
    flows = [{"threadFlows": [{"locations": [step("a"), {}]}, None, {"locations": step("b")}]}, 3, {"threadFlows": {"locations": [step("c")]}}]
    got = [(r[4], r[5]) for r in found(spark, one(codeFlows=flows))]
    assert got == [(0, "a"), (2, "b"), (3, "c")]


def test_labels_link_children_to_parents(spark):
    docs = reports(spark, {"runs": [{"results": []}, {"results": [None, {"locations": [loc("a"), loc("b")]}]}]}, one(loc("c")))
    t = nested.report_tables(docs)
    assert t["runs"].count() == 3 and t["results"].count() == 3 and t["locations"].count() == 3
    for child, parent in (("results", "runs"), ("locations", "results")):
        up = t[parent].select("report_id", F.col("label").alias("parent_label"))
        assert t[child].join(up, ["report_id", "parent_label"], "left_anti").count() == 0
    depth = t["locations"].where(nested.parent_of(F.col("label"), 2) == F.col("parent_label"))
    assert depth.count() == 3


def test_empty_table_and_long_payload(spark):
    assert found(spark) == []
    assert len(found(spark, one(*[loc("p" * 1000) for _ in range(3000)]))) == 3000


def test_the_last_of_repeated_keys_counts(spark):
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    good = json.dumps(one(loc("a.py", startLine=3)))
    payloads = [good.replace('"startLine": 3', '"startLine": 3, "startLine": 5'), '{"runs": [], ' + good[1:], good[:-1] + ', "runs": []}', good]
    assert [(r[0], r[5]) for r in found(spark, *payloads)] == [(0, "a.py:5"), (1, "a.py:3"), (3, "a.py:3")]
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == before


def test_large_reports_come_out_whole(spark, monkeypatch):
    """The way for large documents gives what the other one gives, and documents beyond a VARIANT's limits come out."""
    docs = [
        one(None, 5, loc(" "), loc("a", startLine=3, endLine=9), {}, relatedLocations=loc("y"), codeFlows=[{"threadFlows": {"locations": [{"location": loc("z")}, {}]}}], ruleId="r"),
        {"runs": {"results": {"locations": loc("x")}, "tool": {"driver": {"name": "t", "version": 3}}}}, {"runs": [None, {"results": [7, {"message": {"text": "m"}}]}]},
        [1], None, '{"runs": [1], "runs": [{"results": [{"locations": {}}]}]}', '{"runs": [NaN]}', '{"runs": [}',
    ]

    def seen():
        made = nested.report_tables(reports(spark, *docs))
        return [sorted(map(str, t.collect())) for t in made.values()] + [sorted(map(tuple, nested.rejected_reports(reports(spark, *docs)).collect()))]

    plain = seen()
    assert plain[-1] == [(3, "no object on top"), (4, "null"), (6, "not valid JSON as a whole"), (7, "not valid JSON as a whole")]
    monkeypatch.setattr(nested, "LARGE_DOCUMENT", 1)
    assert seen() == plain
    monkeypatch.undo()

    long = one(loc("u" * 21_000_000, startLine=4), loc("b.py"), message={"text": "m" * 21_000_000})
    many = {"runs": [{"results": [{"locations": [loc(f"f{i}.py")], "note": "n" * 1024} for i in range(132_000)]}]}
    got = nested.report_locations(reports(spark, long, many))
    assert sorted((r.report_id, r.n, r.longest) for r in got.groupBy("report_id").agg(F.count("*").alias("n"), F.max(F.length("locator")).alias("longest")).collect()) == [
        (0, 2, 21_000_002), (1, 132_000, 10),
    ]
    monkeypatch.setattr(nested, "LARGEST_ELEMENT", 50_000)
    big = {"runs": [{"results": [{"locations": [loc("a.py"), {"x": "y" * 17_000_000}]}]}]}
    assert [tuple(r) for r in nested.rejected_reports(reports(spark, big)).collect()] == [(0, "an element of locations is too large")]
    assert [r.locator for r in nested.report_locations(reports(spark, big)).collect()] == ["a.py"]
