"""JSON out of answers on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import answers as A


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column(F.col("t")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


@pytest.mark.parametrize(
    "text, doc",
    [
        ('{"a": 1}', {"a": 1}), ('  ```JSON\n{"a": [1, 2]}\n```  ', {"a": [1, 2]}), ("```\n[1]\n```", {"items": [1]}), ("null", {"items": None}), ("7", {"items": 7}),
        ('so {"a": {"b": 2}} done', {"a": {"b": 2}}), ("} {", {"raw": "} {"}), ('{"a": 1} and {"b": 2}', {"raw": '{"a": 1} and {"b": 2}'}), ("1],[2", {"raw": "1],[2"}), ("1, 2", {"raw": "1, 2"}), ("", {"raw": ""}), (None, {"raw": ""}),
        ("   ", {"raw": ""}), ('说 "x"', {"raw": '说 "x"'}), ("[" + "1," * 20000 + "1]", {"items": [1] * 20001}),
    ],
)
def test_documents(spark, text, doc):
    assert json.loads(values(spark, lambda t: F.to_json(A.json_document(t)), [text])[0]) == doc


def test_local_answers(spark):
    texts = ['<think>{"x": 1}</think>{"a": 1}', 'first {"a": 1} last', "no", None, "<THINK a>open {} [1]"]
    got = values(spark, lambda t: F.struct(A.local_answer(t)["cleaned"].alias("c"), F.to_json(A.local_answer(t)["json"]).alias("j")), texts)
    assert [tuple(x) for x in got] == [('{"a": 1}', '{"a":1}'), ('{"a": 1}', '{"a":1}'), ("no", None), ("", None), ("{}", "{}")]


def test_shapes(spark):
    good = {"worthEmail": True, "importance": 1, "reason": "", "tags": []}
    bad = [{**good, **x} for x in ({"worthEmail": "true"}, {"importance": 5.1}, {"importance": "3"}, {"importance": None}, {"reason": None}, {"tags": {}})]
    less = [{k: v for k, v in good.items() if k != out} for out in good]
    assert values(spark, lambda t: A.is_decision(F.try_parse_json(t)), list(map(json.dumps, [good, {**good, "importance": 5}, *bad, *less, [good], 1]))) == [True, True] + [False] * (len(bad) + len(less) + 2)
    good = {"ok": False, "riskLevel": "low", "issues": [], "missingCriticalTerms": ["a"], "reason": "r", "more": 1}
    bad = [{**good, **x} for x in ({"ok": 0}, {"riskLevel": "LOW"}, {"riskLevel": 1}, {"issues": None}, {"missingCriticalTerms": "a"}, {"reason": 2})]
    assert values(spark, lambda t: A.is_quality(F.try_parse_json(t)), [*map(json.dumps, [good, *bad]), None]) == [True] + [False] * (len(bad) + 1)


@pytest.mark.parametrize(
    "value, items",
    [
        ({"points": ["b"], "items": ["a", "A ", "c  d"]}, ["a", "c d", "b"]), ({"items": [], "x": "only"}, ["[]", "only"]), ({"items": "text", "facts": {}}, ["text"]), (list(range(12)), [str(i) for i in range(8)]),
        ([None, "", " ", True, False, 1.5], ["True", "False", "1.5"]), ([{"time": 0, "source": "s", "label": "l", "text": "", "fact": "f"}], ["s l f"]), ([{"other": 1}], []),
        ("one", ["one"]), ("", []), (0, []), (False, []), (None, []), ([], []), ({}, []), (["你 好", "你　好"], ["你 好"]),
    ],
)
def test_items(spark, value, items):
    assert values(spark, lambda t: A.items(F.try_parse_json(t)), [json.dumps(value)]) == [items]


def test_missing_values_and_empty_tables(spark):
    assert values(spark, lambda t: A.items(F.try_parse_json(t)), [None]) == [[]]
    assert values(spark, lambda t: A.items(A.json_document(t)), []) == []
