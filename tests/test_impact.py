import random
import sys
import time
from pathlib import Path

import duckdb
import pytest
from factloom import catalog_queries  # noqa: F401
from factloom import plans
from factloom import queries as Q
from factloom.operators import impact

sys.path.insert(0, str(Path(__file__).parent))
from plan_rows import operators, shuffled_rows  # noqa: E402


def queue(relationships, entities, roots, max_depth, max_fan_out, min_confidence, max_nodes):
    """A priority queue, plainly: strongest first, then the least key."""
    adjacent = {}
    for i, kind, s, t, c in relationships:
        incoming, outgoing = impact.RULES[kind]
        adjacent.setdefault(s, []).append((outgoing * c, i, kind, t))
        adjacent.setdefault(t, []).append((incoming * c, i, kind, s))
    taken = {r: (1.0, ()) for r in sorted(roots) if r in entities}
    line, cut = [(-1.0, r, ()) for r in taken], False
    while line:
        line.sort()
        less, at, path = line.pop(0)
        if len(path) >= max_depth:
            continue
        steps = sorted((x for x in adjacent.get(at, []) if x[0] > 0), key=lambda x: (-x[0], x[1]))
        cut |= len(steps) > max_fan_out
        for weight, i, _, to in steps[:max_fan_out]:
            c = -less * weight
            if to not in entities or c < min_confidence or to in taken and taken[to][0] >= c:
                continue
            if to not in taken and len(taken) >= max_nodes:
                cut = True
                continue
            taken[to] = (c, (*path, i))
            line.append((-c, to, (*path, i)))
    return taken, cut


@pytest.mark.parametrize("seed,max_nodes,fan_out", [(1, 200, 25), (2, 12, 25), (3, 200, 3), (4, 9, 2), (5, 2, 5)])
def test_best_first_equals_the_queue(spark, seed, max_nodes, fan_out):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(40)]
    edges = [(f"e{i:03d}", rng.choice(list(impact.RULES)), *rng.sample(names, 2), round(rng.uniform(0.4, 1), 3)) for i in range(90)]
    edges += [(f"f{i:03d}", "CONTAINS", "n00", names[i], 1.0) for i in range(1, 12)]
    entities, roots = set(names) - {"n07"}, ["n00", "n05", "n31", "missing"]
    frames = spark.createDataFrame(edges, "id string, kind string, source_key string, target_key string, confidence double"), spark.createDataFrame([(x,) for x in entities], "stable_key string"), spark.createDataFrame([(x,) for x in roots], "stable_key string")
    got, cut = impact.best_first(*frames, max_fan_out=fan_out, max_nodes=max_nodes)
    want, was_cut = queue(edges, entities, roots, 4, fan_out, 0.2, max_nodes)
    rows = {r["stable_key"]: (r["confidence"], tuple(s["id"] for s in r["path"])) for r in got.collect()}
    assert rows == want and cut == was_cut


def test_names_of_any_length_match(spark):
    tests = spark.createDataFrame([("t1", "dbpool", []), ("t2", "x", []), ("t3", "other", []), ("t4", "", [])], "stable_key string, test_name string, path_kinds array<string>")
    none = spark.createDataFrame([], "stable_key string, confidence double")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    found = lambda n: {r["stable_key"] for r in impact.recommend_tests(tests, none, n).collect()}
    assert found(names("db")) == {"t1"} and found(names("x", "")) == {"t2"} and found(names("o")) == {"t1", "t3"} and found(names()) == set()


def test_the_strongest_steps_take_one_shuffle(spark):
    edges = spark.range(300).selectExpr("concat('r', id) id", "'CALLS' kind", "'hub' source_key", "concat('k', id) target_key", "cast(0.9 as double) confidence")
    steps = impact.weighted_steps(edges, 5)
    names = operators(steps)
    assert names.count("ShuffleExchangeExec") == 1 and "WindowGroupLimitExec" in names
    assert sorted(r["id"] for r in steps.where("node = 'hub'").collect()) == ["r0", "r1", "r10", "r100", "r101"]


def test_no_level_shuffles_the_steps_again(spark):
    edges = spark.range(4000).selectExpr("concat('r', id) id", "'CALLS' kind", "concat('n', id) source_key", "concat('n', id + 1) target_key", "cast(0.9 as double) confidence")
    roots = spark.createDataFrame([("n9",)], "stable_key string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for run in (impact.affected, impact.evidence_paths):
            assert shuffled_rows(spark, lambda: run(edges, roots, min_confidence=0.1).collect()) < 2 * 8000  # noqa: B023
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffles(spark, run):
    """How many rows each stage of run() wrote for a shuffle."""

    def written():
        gateway = spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    run()
    return [n for i, n in sorted(written().items()) if i not in before]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_kept_tables_leave_no_shuffles(spark):
    before = shuffle_files(spark)
    rows = spark.range(100).selectExpr("concat('n', id) node", "id")
    both = [plans.kept(rows.repartition(3, "id")), plans.kept_by([rows, rows], "node")]
    for _ in range(50):  # files go in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and [t.count() for t in both] == [100, 200]


def test_both_directions_are_written_in_turn_and_meet_by_bucket(spark):
    edges = spark.range(4000).selectExpr("concat('r', id) id", "'CALLS' kind", "concat('n', id) source_key", "concat('n', id + 1) target_key", "cast(0.9 as double) confidence")
    roots = spark.createDataFrame([("n9",)], "stable_key string")
    wide = [r for r in shuffles(spark, lambda: impact.evidence_paths(edges, roots, max_depth=1).collect()) if r > 1000]
    assert wide == [4000, 4000]


def test_best_first_shuffles_steps_once(spark):
    edges = spark.range(4000).selectExpr("concat('r', id) id", "'CALLS' kind", "concat('n', id) source_key", "concat('n', id + 1) target_key", "cast(0.9 as double) confidence")
    entities = spark.range(4001).selectExpr("concat('n', id) stable_key")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        wide = shuffles(spark, lambda: impact.best_first(edges, entities, spark.createDataFrame([("n9",)], "stable_key string")))
        assert sum(r > 7000 for r in wide) == 2  # the steps by node, the neighbours that may be strange
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_evidence_paths_follow_every_step_of_a_hub(spark):
    edges = spark.range(60).selectExpr("concat('r', id) id", "'CALLS' kind", "concat('k', id) source_key", "'hub' target_key", "cast(0.9 as double) confidence")
    found = impact.evidence_paths(edges, spark.createDataFrame([("hub",)], "stable_key string"), max_depth=1).collect()
    assert {r["stable_key"] for r in found} == {"hub", *(f"k{i}" for i in range(60))}


def test_evidence_paths_of_the_tables_lack_nothing(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer", "orders", "part", "lineitem"):
        duck.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = dict(duck.sql(f"{Q._E} {Q._affected_sql(3, 10**9, 0.2)} SELECT stable_key, confidence FROM best").fetchall())
    got = {r["stable_key"]: r["confidence"] for r in Q.QUERIES["evidence_paths"](spark, sf).collect()}
    assert got == pytest.approx(want)
