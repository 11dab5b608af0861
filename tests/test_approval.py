"""Gates over JSON: missing, ill-typed and refused evidence."""

import pytest

from marlstone.operators import approval
from marlstone.operators.approval import Rule


def test_every_reason_is_told_apart(spark):
    rules = [Rule("a", "$.n", "number", ">=", 1), Rule("a", "$.deep.list[1]", "string", "=", "x"), Rule("b", "$.ok", "boolean", "=", True), Rule("b", "$.n", "number", "=", other=("a", "$.n"))]
    good_a, good_b = '{"n": 2, "deep": {"list": ["y", "x"]}}', '{"ok": true, "n": 2.0}'
    cases = [
        (good_a, good_b, []), (None, good_b, ["a:absent", "b.n:unmatched"]), ("{", good_b, ["a:unreadable", "b.n:unmatched"]), ('{"n": "2", "deep": {"list": ["y"]}}', good_b, ["a.n:ill_typed", "a.deep.list[1]:missing", "b.n:unmatched"]),
        ('{"n": 0, "deep": {"list": [1, 2]}}', '{"ok": "true", "n": 0}', ["a.n:refused", "a.deep.list[1]:ill_typed", "b.ok:ill_typed"]), (good_a, '{"ok": null, "n": 3}', ["b.ok:missing", "b.n:refused"]), (good_a, '{"ok": false, "n": 2}', ["b.ok:refused"]),
        ("[1, 2]", good_b, ["a.n:missing", "a.deep.list[1]:missing", "b.n:unmatched"]),
    ]
    table = lambda k: spark.createDataFrame([(i, c[k]) for i, c in enumerate(cases) if c[k] is not None], "id int, body string")
    a, b = table(0), table(1)
    twice = spark.createDataFrame([(90, good_b), (90, good_b)], "id int, body string")
    got = {r.id: (r.failures, r.approved) for r in approval.judged(approval.documents({"a": a, "b": b.union(twice)}, "id", "body"), rules).collect()}
    for i, (_, _, want) in enumerate(cases):
        assert got[i] == (want, not want)
    assert got[90] == (["a:absent", "b:repeated"], False)
    assert approval.judged(approval.documents({"a": a.limit(0), "b": b.limit(0)}, "id", "body"), rules).count() == 0


def test_null_bodies_are_unreadable(spark):
    df = spark.createDataFrame([(1, None)], "id int, body string")
    r = approval.judged(approval.documents({"a": df}, "id", "body"), [Rule("a", "$.n", "number", ">", 0)]).first()
    assert r.failures == ["a:unreadable"] and not r.approved
    with pytest.raises(KeyError):
        approval.reason(Rule("a", "$.n", "date"))
