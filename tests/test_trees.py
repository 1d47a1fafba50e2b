"""Trees deeper than a few levels."""

from scriptorium.operators import trees


def test_leaves_far_below_count(spark):
    # n0 has a done leaf below it and, 10 levels down, one that is not done
    nodes = spark.createDataFrame([("n0", None), ("a", "n0")] + [(f"n{i}", f"n{i - 1}") for i in range(1, 11)], "id string, parent string")
    needs = spark.createDataFrame([("a", "n0")], "id string, needs string")
    for done, met in ((["a"], False), (["a", "n10"], True)):
        got = trees.met(nodes, needs, spark.createDataFrame([(x,) for x in done], "id string"))
        assert {r.id: r.met for r in got.collect()}["a"] is met


NODES = [("c", None), ("a", "c"), ("b", "c"), ("a1", "a"), ("a2", "a"), ("b1", "b"), ("b2", "b")]
NEEDS = [("b1", "a"), ("b", "a1"), ("a2", "b"), ("b2", "b1")]


def course(spark, done):
    return spark.createDataFrame(NODES, "id string, parent string"), spark.createDataFrame(NEEDS, "id string, needs string"), spark.createDataFrame([(x,) for x in done], "id string")


def ids(rows):
    return sorted(r.id for r in rows.collect())


def test_dependencies_reach_and_unlocks(spark):
    nodes, needs, done = course(spark, ["a1", "a2"])
    assert {r.id: r.met for r in trees.met(nodes, needs, done, 2).collect()} == {"c": True, "a": True, "b": True, "a1": True, "a2": False, "b1": True, "b2": False}
    assert sorted(r.id for r in trees.reachable(nodes, needs, done, 2).where("reachable").collect()) == ["a", "a1", "b", "b1", "c"]
    assert ids(trees.next_leaf(nodes, needs, done, ["id"], depth=2)) == ["b1"]
    assert ids(trees.unlocked(nodes, needs, done, ["id"], depth=2)) == ["a", "a1", "a2", "b", "b1", "c"]
    # an ancestor whose own dependency is not met holds back all below it
    nodes, needs, done = course(spark, [])
    assert ids(trees.reachable(nodes, needs, done, 2).where("reachable")) == ["a", "a1", "c"]
    assert ids(trees.next_leaf(nodes, needs, course(spark, ["a1", "a2", "b1", "b2"])[2], ["id"], depth=2)) == []


def test_stage_is_celebrated_once(spark):
    nodes, _, some = course(spark, ["a1", "a2", "b1"])
    all_ = course(spark, ["a1", "a2", "b1", "b2"])[2]
    assert [tuple(r) for r in trees.celebrations(nodes, some, all_, depth=2).collect()] == [("c", 4, 4)]
    assert trees.celebrations(nodes, all_, all_, depth=2).isEmpty()
    assert trees.celebrations(nodes, some, some, depth=2).isEmpty()
