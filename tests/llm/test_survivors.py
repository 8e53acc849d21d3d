"""Survivors beside plain Python, and the layers beside pairwise dominance."""

import datetime
import random

from cairnset.llm import survivors

CLAIMS = "claim_ord long, claim_id string, tool string, title string, weakness string, severity string, recorded_at timestamp_ntz, trust int"
MERGES = "merge_key string, claim_ids array<string>, titles array<string>, claim_ord int"


def clean(x):
    return " ".join((x or "").split()) or None


def brute(merges, claims, tools, void):
    out = set()
    for key in {m[0] for m in merges if m[0] is not None}:
        ids = {i.strip() for m in merges if m[0] == key for i in m[1] or [] if i and i.strip()}
        titles = {clean(t) for m in merges if m[0] == key for t in m[2] or [] if clean(t)}
        for f, col in (("title", 3), ("weakness", 4), ("severity", 5)):
            ok = []
            for c in claims:
                v = (c[col] or "").strip()
                if c[1] not in ids or not v or v.lower() in void or (f == "title" and clean(v) not in titles):
                    continue
                t = tools.get((c[2] or "").strip().lower(), 0)
                ok.append((-t, -(c[6].timestamp() if c[6] else -1e12), c[0]))
            if ok:
                out.add((key, f, min(ok)[2]))
    return out


def tables(spark, merges, claims, tools, void):
    return (
        spark.createDataFrame([(*m, 1) for m in merges], MERGES),
        spark.createDataFrame([(*c, 5) for c in claims], CLAIMS),
        spark.createDataFrame(list(tools.items()), "tool string, trust int"),
        spark.createDataFrame([(v,) for v in void], "term string"),
    )


def test_against_plain_python(spark):
    rnd = random.Random(11)
    day = datetime.datetime(2025, 1, 1)
    tools, void = {"a": 5, "b": 9, "c": 5}, {"n/a", "none"}
    claims = [
        (
            i, rnd.choice([f"id{i % 20}", f"id{i % 7}", None, ""]), rnd.choice(["a", " B ", "c", "zz", None]), rnd.choice(["T one", "T  two ", "N/A", " ", None, "three"]),
            rnd.choice(["w", "none", "", None]), rnd.choice(["high", " Low ", "n/a"]), rnd.choice([None, day, day + datetime.timedelta(days=rnd.randrange(3))]),
        )
        for i in range(120)
    ]
    merges = [
        (rnd.choice(["k1", "k2", "k3", "k4", None]), rnd.choice([None, [], [f"id{rnd.randrange(25)}", " id3 ", "", None, "gone"]]), rnd.choice([None, ["T one"], [" T two", None, "three"], [" "]]))
        for _ in range(40)
    ]
    t = tables(spark, merges, claims, tools, void)
    got = {tuple(r) for r in survivors.merge_survivors(*t).collect()}
    assert got == brute(merges, claims, tools, void)
    rows = survivors.dominance_layers(survivors.group_points(*t)).collect()
    for r in rows:
        mine = [x for x in rows if x.merge_key == r.merge_key]

        def beats(x, y):
            time = lambda p: (p.recency.at is not None, p.recency.at, p.recency.no) if p.recency.at else (False, None, p.recency.no)
            dims = all(getattr(x, f"has_{f}") >= getattr(y, f"has_{f}") for f in survivors.FIELDS) and x.trust >= y.trust
            return x is not y and dims and (time(x)[0], str(time(x)[1]), time(x)[2]) >= (time(y)[0], str(time(y)[1]), time(y)[2])

        above = [x.layer for x in mine if beats(x, r)]
        assert r.layer == 1 + max(above, default=0)


def test_empty_tables(spark):
    t = tables(spark, [("k", ["a"], ["t"])], [(1, "a", "x", "t", "w", None, None)], {"x": 1}, {"none"})
    assert {tuple(r) for r in survivors.merge_survivors(*t).collect()} == {("k", "title", 1), ("k", "weakness", 1)}
    for i in range(2):
        parts = [x.limit(0) if i == j else x for j, x in enumerate(t)]
        assert survivors.merge_survivors(*parts).count() == 0
    assert survivors.merge_survivors(t[0], t[1], t[2].limit(0), t[3].limit(0)).count() == 2
