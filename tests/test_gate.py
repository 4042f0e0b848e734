"""The claim gate: every proposal ends as its name says; policies, limits and registry versions by table."""

import pytest

from cairn.operators import gate
from cairn.plans import admission


@pytest.fixture(scope="module")
def decided(spark):
    return {r["id"]: r for r in gate.decided(*admission._inputs(spark), admission.POLICY).collect()}


def test_every_proposal_ends_as_named(decided):
    assert len(decided) == len(admission.PROPOSALS) == len({p["id"] for p in admission.PROPOSALS})
    assert [i for i, r in decided.items() if r["verdict"] != i.split("-")[0]] == []
    assert {r["code"] for r in decided.values()} == {None, "unregistered_predicate", "invalid_value", "secret_detected", "no_provenance", "source_unavailable", "policy_denied", "below_score_floor", "authority_insufficient"}


@pytest.mark.parametrize(
    "id_, expected",
    [
        ("admit-own", ("user_asserted", "user", "")), ("admit-correct", ("user_corrected", "user", "c-supplier")), ("admit-over-own", ("user_corrected", "user", "")), ("admit-seed", ("extracted", "seed", "")), ("admit-lowered", ("extracted", "supplier", "")), ("admit-reviewed", ("inferred", "supplier", "")),
    ],
)
def test_authority_and_sourcing(decided, id_, expected):
    r = decided[id_]
    assert (r["authority"], r["sourcing"], r["conflicts"]) == expected


def test_the_earliest_fault_wins(decided):
    assert decided["refuse-first"]["code"] == "secret_detected" and decided["refuse-over-supplier"]["rule"] == "user_supersedes_supplier"


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, None), ({"id": " "}, "unnamed"), ({"version": 0}, "unnamed"), ({"ceilings": [("rule", "extracted"), ("rule", "inferred")]}, "duplicate_ceiling"), ({"ceilings": [("rule", "verified")]}, "ceiling_raised"), ({"ceilings": [("review_approval", "inferred")]}, "ceiling_raised"),
        ({"ceilings": [("rule", "inferred")]}, None), ({"qualified": [("stay", "rate", "inferred")]}, "qualified_on_inference"), ({"qualified": [("stay", "rate", "extracted")]}, None),
    ],
)
def test_policies(change, expected):
    assert gate.policy_problem({"id": "house", "version": 1} | change) == expected


def test_limits_only_narrow():
    wide = {"bytes": 100, "kinds": frozenset({"a", "b"})}
    assert gate.narrowed({"bytes": 50, "kinds": frozenset({"a"})}, wide) == {"bytes": 50, "kinds": frozenset({"a"})} and gate.narrowed({}, wide) == wide
    for wider in ({"bytes": 101}, {"kinds": frozenset({"c"})}, {"other": 1}):
        with pytest.raises(ValueError):
            gate.narrowed(wider, wide)


FIRST = {"namespace": "stay", "version": 1, "kinds": ["room"], "predicates": {"rate": ("one", "decimal", ["EUR"], []), "state": ("one", "enum", [], ["open"])}}


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, "unchanged"), ({"kinds": ["room", "bed"]}, "conflicting_version"), ({"version": 0}, "not_after_latest"), ({"version": 2}, None), ({"version": 7, "kinds": ["room", "bed"]}, None), ({"version": 2, "kinds": ["bed"]}, "subject_kind_removed"), ({"namespace": "cairn"}, "reserved_namespace"), ({"namespace": "trip"}, None),
        ({"version": 2, "predicates": {"rate": FIRST["predicates"]["rate"]}}, "predicate_removed"), ({"version": 2, "predicates": FIRST["predicates"] | {"rate": ("many", "decimal", ["EUR"], [])}}, "cardinality"), ({"version": 2, "predicates": FIRST["predicates"] | {"rate": ("one", "decimal", [], [])}}, "value_type"),
        ({"version": 2, "predicates": FIRST["predicates"] | {"state": ("one", "enum", [], ["open", "shut"])}}, None), ({"version": 2, "predicates": FIRST["predicates"] | {"state": ("one", "text", [], ["open"])}}, "value_type"),
    ],
)
def test_registry_versions(change, expected):
    assert gate.registered([FIRST], FIRST | change) == expected
