import pytest
from factloom.operators import activation as A


@pytest.fixture
def catalog(spark):
    frame = spark.createDataFrame
    return A.Catalog(
        frame([("1", "shop", "r2", "a", "staged"), ("2", "shop", "r2", "b", "staged"), ("3", "other", "r2", "c", "staged"), ("4", "shop", "r2", "d", "active"), ("5", "shop", "r2", "a", "staged"), ("6", "shop", "r2", "lost", "staged"), ("7", "shop", "r2", "f", "staged")], "run_id string, repository_id string, revision_id string, artifact_id string, status string"),
        frame([("a", "shop", "r1"), ("b", "shop", "r1"), ("c", "shop", "r1"), ("d", "shop", "r2"), ("f", "other", "r1"), ("old", "shop", "r1")], "artifact_id string, repository_id string, active_revision string"),
        frame([("r1", "shop", "active"), ("r2", "shop", "staged"), ("r9", "other", "active"), ("r0", "shop", "failed")], "revision_id string, repository_id string, status string"),
        frame([("facts:shop:r1",)], "idempotency_key string"),
        frame([("A", "a", "r0", "r1"), ("A2", "a", "r1", "r1"), ("C", "c", "r1", "r1"), ("O", "old", "r1", "r1")], "stable_key string, artifact_id string, first_seen string, last_seen string"),
        frame([("CALLS", "C", "A", "c", "r1", "r1"), ("CALLS", "C", "A2", "c", "r1", "r1"), ("CALLS", "A", "C", "a", "r1", "r1"), ("CALLS", "C", "O", "c", "r1", "r1")], "kind string, source_key string, target_key string, artifact_id string, first_seen string, last_seen string"),
    )


def ask(spark, runs, deleted=(), repository="shop", revision="r2"):
    return A.Request(repository, revision, spark.createDataFrame([(r,) for r in runs], "run_id string"), spark.createDataFrame([(x,) for x in deleted], "artifact_id string"))


def staged(spark, entities=(), relationships=()):
    return spark.createDataFrame(list(entities), "run_id string, stable_key string"), spark.createDataFrame(list(relationships), "run_id string, kind string, source_key string, target_key string")


@pytest.mark.parametrize("runs,deleted,more,rule,subject", [
    (["1", "1"], [], {}, 0, "1"), (["1", "99"], [], {}, 1, "99"), (["1", "3"], [], {}, 2, "3"), (["1", "4"], [], {}, 3, "active"), (["1", "5"], [], {}, 4, "a"),
    (["1"], ["a"], {}, 5, "a"), (["6"], [], {}, 6, "lost"), (["1"], ["gone"], {}, 6, "gone"), (["7"], [], {}, 7, "f"), (["1"], [], {"revision": "r5"}, 8, "r5"), (["1"], [], {"repository": "else"}, 9, "r2"),
])
def test_each_rule_forbids(spark, catalog, runs, deleted, more, rule, subject):
    found = {(r["rule"], r["subject"]) for r in A.violations(ask(spark, runs, deleted, **more), catalog, *staged(spark)).collect()}
    assert (A.RULES[rule], subject) in found
    with pytest.raises(ValueError):
        A.activate(ask(spark, runs, deleted, **more), catalog, *staged(spark))


def test_relationship_without_an_end(spark, catalog):
    facts = staged(spark, [("1", "A")], [("1", "CALLS", "A", "C"), ("1", "CALLS", "A", "A2"), ("1", "CALLS", "A", "O")])
    found = {(r["rule"], r["subject"]) for r in A.violations(ask(spark, ["1"], ["old"]), catalog, *facts).collect()}
    assert found == {(A.RULES[10], "A2"), (A.RULES[10], "O")}  # one that its artifact no longer has, one of a deleted artifact


def test_activated(spark, catalog):
    facts = staged(spark, [("1", "A"), ("2", "B")], [("1", "CALLS", "A", "B"), ("2", "CALLS", "B", "C"), ("7", "CALLS", "X", "Y")])
    after = A.activate(ask(spark, ["1", "2"], ["old"]), catalog, *facts)
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(after.entities) == {("A", "a", "r0", "r2"), ("B", "b", "r2", "r2"), ("C", "c", "r1", "r1")}
    assert rows(after.relationships) == {("CALLS", "C", "A", "c", "r1", "r1"), ("CALLS", "A", "B", "a", "r2", "r2"), ("CALLS", "B", "C", "b", "r2", "r2")}
    assert rows(after.revisions) == {("r1", "shop", "superseded"), ("r2", "shop", "active"), ("r9", "other", "active"), ("r0", "shop", "failed")}
    assert {r["artifact_id"]: r["active_revision"] for r in after.artifacts.collect()} == {"a": "r2", "b": "r2", "c": "r1", "d": "r2", "f": "r1"}
    assert {r["run_id"]: r["status"] for r in after.runs.collect()} == {"1": "active", "2": "active", "3": "staged", "4": "active", "5": "staged", "6": "staged", "7": "staged"}
    assert rows(after.outbox) == {("facts:shop:r1",), ("facts:shop:r2",)}
    assert A.activate(ask(spark, ["1", "2"], ["old"]), after, *facts) is None  # a second time it is done already
    assert A.activate(ask(spark, [], revision="r1"), catalog, *staged(spark)) is None


def test_nothing_staged_may_still_delete(spark, catalog):
    after = A.activate(ask(spark, [], ["old"]), catalog, *staged(spark))
    assert {r["stable_key"] for r in after.entities.collect()} == {"A", "A2", "C"}
