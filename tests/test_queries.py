"""Every core query beside its SQL twin, and every vocabulary value met."""

import pytest

import oracle
from cairnset.plans import decisions, followup, intake, numbered, triage

FOLDER = "/root/testdata/sf0.001"
QUERIES = {**numbered.QUERIES, **triage.QUERIES, **followup.QUERIES, **decisions.QUERIES, **intake.QUERIES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, name):
    said = oracle.compare(spark, FOLDER, name)
    assert ": same " in said or "no SQL" in said, said


def test_vocabularies_are_produced(spark):
    met = {}
    for name, column in (("resolve_status", "resolution"), ("identity_key", "kind"), ("reachability_verdict", "verdict"), ("baseline_state", "state"), ("span_state", "span_state"), ("verdict_combine", "verdict"), ("anchor_states", "span_state"), ("triage_items", "state"), ("verify_artifacts", "verdict"), ("verify_bindings", "verdict")):
        met[name] = {r[0] for r in QUERIES[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()}
    assert met["resolve_status"] == {"resolves", "path_absent", "line_out_of_range", "not_a_locator"}
    assert met["identity_key"] == {"site+weakness", "site", "topic", "opaque"}
    assert met["reachability_verdict"] == {"reachable_from", "no_caller_found", "not_determinable"}
    assert met["baseline_state"] == {"new", "stale", "carried"}
    assert met["span_state"] >= {"unchanged", "changed", "absent"}
    assert met["anchor_states"] == {"unchanged", "changed", "absent", "moved"}
    assert met["triage_items"] == {"new", "stale", "carried"}
    assert met["verify_artifacts"] == met["verify_bindings"] == {"verified", "unverifiable", "contradicted"}
    assert met["verdict_combine"] == {"verified", "unverifiable", "contradicted"}
    checked = followup.verify_checks(spark, "/root/testdata/sf0.01").select("verdict").distinct()
    assert {r[0] for r in checked.collect()} == {"verified", "contradicted", "unverifiable"}
