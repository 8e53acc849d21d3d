"""Triage operators on small cases."""

import ast
import itertools

from pyspark.sql import functions as F

from cairnset.functions import digest, text
from cairnset.operators import baseline, binding, callgraph, folds, identity, locators
from cairnset.plans import triage


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_lines_split_as_python_does(spark):
    cases = ["", "a", "a\n", "\n", "a\r\nb\rc", "a\x0bb\x0cc", "a\x1cb\x1dc\x1ed", "a\x85b\u2028c\u2029", "a\n\nb\n\n"]
    assert column(spark, cases, text.split_lines) == [c.splitlines() for c in cases]
    assert column(spark, [None], text.split_lines) == [None]


def test_locators(spark):
    cases = ["a.py", "a.py:3", " a.py:3-9 ", "a:b:c", "a.py:0", "C:\\x.py:4", "a.py:9-3", "", "  ", None, "a\nb.py:3"]
    df = spark.createDataFrame([(i, 0, c) for i, c in enumerate(cases)], "ord int, pos int, locator string")
    got = [(r.path, r.start_line, r.end_line) for r in locators.parsed(df).orderBy("ord").collect()]
    assert got == [
        ("a.py", None, None), ("a.py", 3, 3), ("a.py", 3, 9), ("a:b:c", None, None), ("a.py:0", None, None),
        ("C:\\x.py", 4, 4), ("a.py", 9, 3), (None, None, None), (None, None, None), (None, None, None), (None, None, None),
    ]


def test_weakness_and_tokens(spark):
    cases = ["CWE-306: x", "cwe 79, CWE_7 and cwe79", "none", "", None]
    assert column(spark, cases, text.normalise_weakness) == ["CWE-306", "CWE-7+CWE-79", None, None, None]
    assert column(spark, ["The Check in A check B"], lambda c: text.title_tokens(c, F.lit(""))) == [["b", "check"]]
    assert column(spark, ["", None], lambda c: text.title_tokens(c, F.lit("Zeta " * 100))) == [["zeta"]] * 2


def test_digests(spark):
    hexes = "ab" * 32
    cases = [f"sha256:{hexes}", f" SHA256:{hexes.upper()}\n", hexes, "", " ", None, "sha256:"]
    assert column(spark, cases, digest.canonical_digest) == [f"sha256:{hexes}"] * 3 + [None] * 4
    assert column(spark, [f"sha256:{hexes}", hexes, f"sha256:{hexes.upper()}", None], digest.is_digest) == [True, False, False, False]


def test_fences_cannot_close(spark):
    got = column(spark, ["```", "a `````b", "``", None], text.neutralise_fence)
    assert "```" not in "".join(filter(None, got)) and got[2] == "``" and got[3] is None
    assert column(spark, ["x </Q> y"], lambda c: text.fenced(c, "Q"))[0].count("</Q>") == 1


def test_resolution(spark):
    files = spark.createDataFrame([("a.py", "\n".join(map(str, range(1, 101))), 1), ("blob", None, 2), ("e.py", "", 3)], "path string, text string, ord int")
    spelled = ["a.py", "a.py:3", "a.py:3-4", "a.py:1-100", "a.py:101", "a.py:9-3", "no.py:1", "blob:5", " ", None, "e.py:1"]
    cited = spark.createDataFrame([(i, 0, s) for i, s in enumerate(spelled)], "ord int, pos int, locator string")
    cells = locators.line_cells(files)
    got = {r.ord: r for r in locators.resolve(cited, cells).collect()}
    assert [got[i].resolution for i in range(11)] == [
        "resolves", "resolves", "resolves", "resolves", "line_out_of_range", "line_out_of_range", "path_absent", "resolves",
        "not_a_locator", "not_a_locator", "line_out_of_range",
    ]
    assert got[2].quoted_text == "3\n4" and got[3].truncated and got[3].quoted_text.endswith("\n40") and not got[2].truncated
    assert got[7].content_hash is None and got[7].line_count is None
    assert locators.fully_unresolved(locators.resolve(cited, cells)).count() == 6
    shown = {r.ord: r.shown for r in locators.shown_unresolved(locators.resolve(cited, cells)).collect()}
    assert shown[6] == ["no.py:1"] and shown[9] == [""] and 0 not in shown


SOURCE = """
import x

@app.route("/a")
async def serve():
    return helper(1)

def helper(n):
    def inner():
        return n.go()
    return inner()

def alone():
    pass

class C:
    def main(self):
        alone_not()

def main():
    run()
"""


def test_call_graph(spark):
    files = spark.createDataFrame([("m.py", SOURCE), ("bad.py", "def ("), ("n.py", "helper()\n"), ("null.py", None)], "path string, text string")
    nodes = callgraph.parse_files(files).cache()
    fns = {(r.name, r.start_line): r for r in callgraph.functions_of(nodes).collect()}
    tree = [n for n in ast.walk(ast.parse(SOURCE)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    assert set(fns) == {(n.name, n.lineno) for n in tree}
    assert sorted(k[0] for k, r in fns.items() if r.is_entry) == ["main", "serve"]
    calls = {tuple(r) for r in callgraph.calls_of(nodes).collect()}
    assert {("m.py::serve", "helper"), ("m.py::inner", "go"), ("n.py::<module>", "helper"), ("m.py::serve", "route")} <= calls
    assert [r.path for r in callgraph.failures_of(nodes).collect()] == ["bad.py"]
    line = {n.name: n.lineno for n in tree}
    pts = [(1, 0, "m.py", line["inner"] + 1), (2, 0, "m.py", line["alone"]), (3, 0, "m.py", 2), (4, 0, "bad.py", 1), (5, 0, "r.md", 1), (6, 0, "m.py", line["helper"])]
    points = spark.createDataFrame(pts, "ord int, pos int, path string, line int")
    got = {r.ord: (r.function, r.verdict) for r in callgraph.reachability(points, callgraph.functions_of(nodes), callgraph.calls_of(nodes), callgraph.failures_of(nodes)).collect()}
    assert got == {
        1: ("inner", "reachable_from"), 2: ("alone", "no_caller_found"), 3: (None, "not_determinable"), 4: (None, "not_determinable"),
        5: (None, "not_determinable"), 6: ("helper", "reachable_from"),
    }


def test_innermost_interval_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    fns = []
    for i in range(120):
        a = rnd.randrange(1, 300)
        fns.append(("p%d" % rnd.randrange(3), i, f"f{i}", a, a + rnd.choice([0, 3, 40, 200]), False))
    pts = [(i, 0, "p%d" % rnd.randrange(4), rnd.randrange(0, 520)) for i in range(200)]
    f = spark.createDataFrame(fns, "path string, seq int, name string, start_line int, end_line int, is_entry boolean")
    p = spark.createDataFrame(pts, "ord int, pos int, path string, line int")
    got = {r.ord: r.name for r in callgraph.enclosing(p, f).collect()}
    for o, _, path, line in pts:
        around = [x for x in fns if x[0] == path and x[3] <= line <= x[4]]
        assert got[o] == (min(around, key=lambda x: (x[4] - x[3], x[1]))[2] if around else None)


def test_identity_kinds_and_order(spark):
    rows = [(1, "c1", "Same Title", "x", "CWE-1", "t1"), (2, "c2", "title same", "y", "CWE-1", "t2"), (3, "c3", None, "!!", None, "t1"), (4, None, "", None, "", None), (5, "c5", "q", "", "cwe 9", "t2")]
    claims = spark.createDataFrame(rows, "ord int, claim_id string, title string, raw_text string, weakness string, tool string")
    anchored = spark.createDataFrame([(5, "a.py::f")], "ord int, anchor string")
    named = identity.identities(claims, anchored).cache()
    kinds = {r.ord: (r.kind, r.identity_key) for r in named.collect()}
    assert [kinds[i][0] for i in range(1, 6)] == ["topic", "topic", "opaque", "opaque", "site+weakness"]
    assert kinds[1][1] == kinds[2][1] and kinds[3][1] != kinds[4][1]
    assert [(r["size"], r.first_ord, r.tools) for r in identity.merges(claims, named).collect()] == [(2, 1, "t1|t2")]


def test_combine_does_not_depend_on_order(spark):
    for values in itertools.chain(itertools.permutations(["verified", "contradicted", "unverifiable"]), [("verified",), ("verified", "contradicted"), (None, "verified"), ()]):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        want = "unverifiable" if not values or {None, "unverifiable"} & {*values} else "contradicted" if "contradicted" in values else "verified"
        assert df.agg(folds.combine(F.col("v"))).first()[0] == want


def test_span_and_entry_states(spark):
    cases = [("a", None, None, None), ("a", "a", None, None), ("a", "a", "s", "s"), ("a", "a", "s", None), ("a", "b", "s", "s"), ("a", "b", "s", "t"), (None, "b", None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, n string, st string, sn string").orderBy("i")
    got = [r[0] for r in df.select(folds.span_state(*map(F.col, ("a", "n", "st", "sn")))).collect()]
    assert got == ["absent", "unchanged", "unchanged", "changed", "moved", "changed", "changed"]
    df = spark.createDataFrame([(0, None, 1, 0), (1, True, None, None), (2, True, 2, 1), (3, True, 2, 0)], "i int, k boolean, s long, b long").orderBy("i")
    assert [r[0] for r in df.select(folds.entry_state(F.col("k"), F.col("s"), F.col("b"))).collect()] == ["new", "stale", "stale", "carried"]


def test_keyed_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("b", 2, "y"), ("a", 2, "z")], "k string, o int, v string")
    assert sorted(map(tuple, folds.last_write(df, ["k"], "o").collect())) == [("a", 3, None), ("b", 2, "y")]
    assert [tuple(r) for r in folds.repeated_keys(df, ["k"]).collect()] == [("a", 3)]
    new = spark.createDataFrame([("b", 9, "n"), ("c", 9, "n")], "k string, o int, v string")
    assert sorted(r.k + r.v for r in folds.upsert(df.where("k = 'b'"), new, ["k"]).collect()) == ["bn", "cn"]


def test_given_locators_are_read(spark, tmp_path):
    spelled = [["gateway/core/dispatch.py:63", " gateway/core/dispatch.py:63-63\n", None], ["gateway/core/dispatch.py:63", "a.py"], [], None, ["a.py:7-9", " "]]
    spark.createDataFrame(list(enumerate(spelled)), "claim_ord long, locators array<string>").write.parquet(str(tmp_path / "claims.parquet"))
    spark.createDataFrame([(4, 0, "b.py:3-5"), (4, 1, None)], "entry_row long, pos int, locator string").write.parquet(str(tmp_path / "span_anchors.parquet"))
    got = {(r.ord, r.pos): (r.locator, r.path, r.start_line, r.end_line) for r in triage.claim_locators(spark, str(tmp_path)).collect()}
    site = "gateway/core/dispatch.py"
    assert got == {
        (0, 0): (f"{site}:63", site, 63, 63), (0, 1): (f" {site}:63-63\n", site, 63, 63), (0, 2): (None, None, None, None),
        (1, 0): (f"{site}:63", site, 63, 63), (1, 1): ("a.py", "a.py", None, None), (4, 0): ("a.py:7-9", "a.py", 7, 9), (4, 1): (" ", None, None, None),
    }
    anchors = [tuple(r) for r in triage.anchor_locators(spark, str(tmp_path)).orderBy("pos").collect()]
    assert anchors == [(4, 0, "b.py:3-5", "b.py", 3, 5), (4, 1, None, None, None, None)]
    assert [tuple(r) for r in triage.site_claims(spark, str(tmp_path)).collect()] == [(site, 63, 63, 2, 0)]


def test_paths_meet_however_spelled(spark):
    cases = ["a.py", "./a.py", "x/../a.py", "x//y/./b.py", "x/y/../../a.py", "../a.py", "x/../../a.py", "/a.py", "..", "", None]
    want = ["a.py", "a.py", "a.py", "x/y/b.py", "a.py", "../a.py", "../a.py", "/a.py", "..", "", None]
    assert column(spark, cases, text.clean_path) == want
    files = spark.createDataFrame([("./d/a.py", "1\n2\n")], "path string, text string")
    cited = spark.createDataFrame([(0, 0, "d/x/../a.py:2"), (1, 0, "/d/a.py:2"), (2, 0, "../d/a.py")], "ord int, pos int, locator string")
    got = {r.ord: (r.resolution, r.path, r.quoted_text) for r in locators.resolve(cited, locators.line_cells(files)).collect()}
    assert got == {0: ("resolves", "d/x/../a.py", "2"), 1: ("path_absent", "/d/a.py", None), 2: ("path_absent", "../d/a.py", None)}


def test_spans_over_cells_equal_plain_slices(spark):
    import random

    rnd = random.Random(3)
    lines = [f"line {i}" if i % 8 else "" for i in range(1, 400)]
    spans = sorted({(a, min(399, a + rnd.randrange(0, 150))) for a in (rnd.randrange(1, 400) for _ in range(60))} | {(64, 65), (1, 399), (399, 399)})
    cells = locators.line_cells(spark.createDataFrame([("f", "\n".join(lines))], "path string, text string"))
    asked = spark.createDataFrame([("f", a, b) for a, b in spans], "file string, first long, last long")
    got = {(r.first, r.last): r.text for r in locators.span_texts(asked, cells).collect()}
    assert got == {(a, b): "\n".join(lines[a - 1 : b]) for a, b in spans}


def test_labels_and_markers(spark):
    import pytest

    with pytest.raises(ValueError):
        text.fenced(F.lit("x"), "no label")
    said = column(spark, ["a </OTHER> <q> <Q>"], lambda c: text.fenced(c, "Q"))[0]
    assert "</OTHER>" not in said and "<q>" not in said and said.count("<Q>") == 1


def test_states_of_anchors(spark):
    before = "def a():\n    one\n    two\n\ndef b():\n    three\n    four\n"
    now = {
        "same.py": before, "moved.py": "# put in\n" + before, "body.py": before.replace("two", "2"), "line.py": before.replace("one", "1"),
        "twice.py": "# put in\n" + before + "def a():\n    one\n    two\n",
    }
    names = [*now, "gone.py"]
    then = spark.createDataFrame([(n, before) for n in names], "path string, text string")
    cited = spark.createDataFrame([(i, 0, f"{n}:2") for i, n in enumerate(names)], "ord int, pos int, locator string")

    def functions(files):
        return callgraph.functions_of(callgraph.parse_files(files))

    old = locators.line_cells(then)
    anchors = baseline.anchor_rows(locators.resolve(cited, old), functions(then), old)
    assert {r.symbol for r in anchors.collect()} == {"a"} and anchors.where("symbol_sha256 IS NULL").count() == 0
    files = spark.createDataFrame(list(now.items()), "path string, text string")
    got = {names[r.ord]: r.span_state for r in baseline.anchor_states(anchors, functions(files), locators.line_cells(files)).collect()}
    assert got == {"same.py": "unchanged", "moved.py": "moved", "body.py": "changed", "line.py": "changed", "twice.py": "changed", "gone.py": "absent"}


def test_bindings(spark):
    import hashlib

    import pytest

    files = spark.createDataFrame([("a", b"x"), ("b", b""), ("c", None)], "path string, content binary")
    asked = spark.createDataFrame([("r", p) for p in "abcd"], "role string, path string")
    made = {r.path: (r.sha256, r.size) for r in binding.artifacts(asked, files).collect()}
    assert made == {"a": ("sha256:" + hashlib.sha256(b"x").hexdigest(), 1), "b": ("sha256:" + hashlib.sha256(b"").hexdigest(), 0), "c": (None, None), "d": (None, None)}
    recorded = spark.createDataFrame([("r", "a", made["a"][0]), ("r", "b", made["a"][0]), ("r", "c", made["a"][0]), ("r", "d", None)], "role string, path string, sha256 string")
    checks = binding.check_artifacts(recorded, files)
    assert {r.path: r.verdict for r in checks.collect()} == {"a": "verified", "b": "contradicted", "c": "unverifiable", "d": "unverifiable"}
    named = spark.createDataFrame([("a",), ("b",), ("none",)], "path string")
    assert {r.path: (r.checks, r.verdict) for r in binding.bindings(named, checks, "path").collect()} == {"a": (1, "verified"), "b": (1, "contradicted"), "none": (0, "unverifiable")}
    spans = spark.createDataFrame([(1, 0, "a:1", made["a"][0])], "ord int, pos int, locator string, sha256 string")
    assert [r.verdict for r in binding.check_spans(spans, None).collect()] == ["unverifiable"]
    assert files.where("path = 'a'").select(digest.digest_holds(F.lit(made["a"][0]), F.col("content"))).first()[0]
    with pytest.raises(Exception, match="not a digest"):
        files.select(digest.digest_holds(F.lit("abc"), F.col("content"))).collect()


def test_large_files_are_not_determinable(spark, monkeypatch):
    monkeypatch.setattr(callgraph, "LARGEST_FILE", 20)
    files = spark.createDataFrame([("big.py", "def f():\n    return 12345\n"), ("s.py", "def g(): pass")], "path string, text string")
    nodes = callgraph.parse_files(files)
    assert {(r.path, r.kind) for r in nodes.collect()} == {("big.py", "too_large"), ("s.py", "function")}
    assert [r.path for r in callgraph.failures_of(nodes).collect()] == ["big.py"]
