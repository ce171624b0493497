import random
import sys
from pathlib import Path

from factloom.operators import diff

sys.path.insert(0, str(Path(__file__).parent))
from plan_rows import operators  # noqa: E402

SCHEMA = "id string, kind string, source_key string, target_key string, confidence double"


def test_relationship_diff_equals_the_strongest_relationships(spark):
    rng = random.Random(3)
    rows = lambda n: [(f"i{rng.randrange(200)}", rng.choice(["CALLS", "TESTS", None]), rng.choice("abcd"), rng.choice(["a", "b", "c", None]), rng.choice([None, 1.0, 0.5, 0.9, 1.5, float("nan")])) for _ in range(n)]
    for n in (20, 60, 150):
        base, target = (spark.createDataFrame(rows(n), SCHEMA) for _ in range(2))
        plain = lambda df: sorted(map(repr, df.collect()))
        assert plain(diff.relationship_diff(base, target)) == plain(diff._by_index(base, target, ["confidence"]))


def test_confidences_are_compared_without_a_sort(spark, monkeypatch):
    monkeypatch.setattr(diff, "kept", lambda df: df)
    base = spark.createDataFrame([("1", "CALLS", "a", "b", 0.5), ("2", "CALLS", "a", "c", None)], SCHEMA)
    found = diff.relationship_diff(base, base.where("id = '1'"))
    names = operators(found)
    assert found.collect()[0]["change"] == "removed" and not {"SortAggregateExec", "SortMergeJoinExec", "SortExec"} & set(names)
