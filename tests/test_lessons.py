"""Courses as trees, and JSON of any depth, traced by hand."""

import json
import random

from pyspark.sql import functions as F

from scriptorium.operators import lessons, variants

NODES = "course int, id string, parent string, kind string, title string, summary string, rank long"


def test_preorder_prunes_subtrees(spark):
    rows = [
        (1, "a", None, "chapter", "A", None, 2), (1, "b", None, "chapter", "B", None, 1), (1, "b1", "b", "section", " 阶段复盘 一", None, 1), (1, "b11", "b1", "lesson", "x", None, 1), (1, "b12", "b1", "lesson", "复盘", None, 2),
        (1, "b13", "b1", "lesson", "y", None, 3), (1, "b2", "b", "section", "z", None, 5), (1, "b3", "b", "section", "z", None, 5), (1, "b21", "b2", "lesson", "复盘课", None, 1), (2, "a", None, "chapter", "练习", None, 1), (2, "c", "a", "lesson", "t", None, 1),
        (2, "d", None, "chapter", None, None, 2), (1, "lost", "nowhere", "lesson", "t", None, 1),
    ]
    got = sorted((r.course, r.position, r.id, r.parent, r.depth, r.children) for r in lessons.flattened(spark.createDataFrame(rows, NODES)).collect())
    assert got == [(1, 1, "b", None, 0, ["b2", "b3"]), (1, 2, "b2", "b", 1, ["b21"]), (1, 3, "b21", "b2", 2, []), (1, 4, "b3", "b", 1, []), (1, 5, "a", None, 0, []), (2, 1, "d", None, 0, [])]


def test_teaching_order(spark):
    lesson = lambda i, title, rank, parent="s", summary=None: (1, i, parent, "lesson", title, summary, rank)
    rows = [
        (1, "r", None, "chapter", "R", None, 7), (1, "s", "r", "section", "S", None, 2), (1, "t", "r", "section", "阶段练习", None, 1), (1, "t1", "t", "lesson", "x", None, 1),
        lesson("l1", "易错点", 1), lesson("l2", "x", 2, summary="概念"), lesson("l3", "导学", 3), lesson("l4", "x", 4), lesson("l5", "复盘", 5),
    ]
    needs = [(1, "l3", "l1", 0), (1, "l3", "EXT", 1), (1, "l3", "ext", 2), (1, "l2", "l2", 0), (1, "s", "t", 0), (1, "s", "other", 1), (1, "r", "r0", 0)]
    out = lessons.restructured(spark.createDataFrame(rows, NODES), spark.createDataFrame(needs, "course int, id string, needs string, at long"))
    assert {r.id: (r.rank, r.needs) for r in out.collect()} == {
        "r": (7, ["r0"]), "s": (1, ["t", "other"]), "l3": (1, ["EXT"]), "l2": (2, ["l3"]), "l4": (3, ["l2"]), "l1": (4, ["l4"]), "l5": (5, ["l1"]),
    }


def total(value):
    sums = [0, 0, 0]

    def visit(item):
        if isinstance(item, dict):
            for k, names in enumerate((("prompt_tokens", "input_tokens"), ("completion_tokens", "output_tokens"), ("total_tokens",))):
                found = next((item[n] for n in names if n in item), None)
                if isinstance(found, int | float):
                    sums[k] += int(found)
        for child in item.values() if isinstance(item, dict) else item if isinstance(item, list) else ():
            if isinstance(child, dict | list):
                visit(child)

    visit(value)
    return sums[0], sums[1], sums[2] or sums[0] + sums[1]


def test_usage_of_random_json(spark):
    rng = random.Random(8)
    names = ["prompt_tokens", "input_tokens", "completion_tokens", "output_tokens", "total_tokens", "x"]

    def made(depth):
        kind = rng.randrange(8 if depth else 4)
        if kind > 4:
            return {n: made(depth - 1) for n in rng.sample(names, rng.randrange(4))}
        return [made(depth - 1) for _ in range(rng.randrange(4))] if kind == 4 else (rng.randrange(-5, 90), rng.random() * 9, None, rng.choice(["7", True, False]))[kind]

    values = [made(6) for _ in range(300)] + [7, None, {}, []]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "k int, s string").select("k", F.parse_json("s").alias("v"))
    got = {r.k: tuple(r)[1:] for r in variants.usage_tokens(rows, "k", "v").collect()}
    assert got == {i: total(v) for i, v in enumerate(values)}
