"""Terms against a plain reading of the rule, and indexes of parts traced by hand."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import terms as T
from scriptorium.operators import indexes

TOKEN = re.compile(r"[，。、“”‘’：；（）()\[\]【】、《》\s/]+")


def plain_terms(text, limit):
    out, seen = [], set()
    names = [m.group(0) for m in re.finditer(r"\b[A-Za-z][A-Za-z0-9_.+-]{1,31}\b", text or "")]
    names = [n for n in names if len(n) >= 3 or any(c.isupper() for c in n)]
    short = [t for t in TOKEN.split(text or "") if 2 <= len(t) <= 12 and not re.fullmatch(r"\d+(?:\.\d+)?", t)]
    for t in (x.strip(T.MARKS) for x in names + short):
        low = t.lower()
        if t and low not in seen and t not in T.STOPWORDS and not t.isdigit() and not re.fullmatch("[A-Za-z]", t) and len(t) <= 32 and len(out) < limit:
            seen.add(low)
            out.append(t)
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB1é用.+-_ ，/（我们12", max_size=60), min_size=1, max_size=40))
def test_terms_follow_the_rule(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r.i: r.x for r in rows.select("i", T.extract_terms(F.col("t"), 5).alias("x")).collect()}
    assert got == {i: plain_terms(t, 5) for i, t in enumerate(texts)}


def test_critical_terms(spark):
    row = spark.createDataFrame([("2024年 12.5% GPT-4o 的大模型 用API接口 2024年 ab", None)], "a string, b string").select(T.critical_terms(F.col("a")).alias("a"), T.critical_terms(F.col("b")).alias("b"), T.critical_terms(F.col("a"), 2).alias("c")).first()
    assert row.a == ["2024年", "12.5%", "GPT-4o", "的大模型", "API"] and row.b == [] and row.c == ["2024年", "12.5%"]


def test_part_index(spark):
    segments = [
        ("p", 1, 1, " 安装  步骤 ", 0.0, 5.0, "打开终端，点击安装 API。注意权限。"), ("p", 2, 1, "安装 步骤", 5.0, None, " 输入 key；运行 "), ("p", 3, None, None, None, None, "大家好 点赞 投币 关注"), ("p", 4, 2, "x", 9.0, 8.0, None), ("q", 1, 0, "x", None, None, ""),
    ]
    blocks = [("p", "b2", 2, ["安装 步骤", None]), ("p", "b1", 1, ["安装  步骤", "安装 步骤", "x"]), ("p", "b3", 3, None)]
    df = spark.createDataFrame(segments, "k string, `order` int, page int, label string, `from` double, `to` double, text string")
    index = indexes.part_index(df, spark.createDataFrame(blocks, "k string, block_id string, `order` int, labels array<string>"), "k")
    got = {(r.k, r.part_id): r for r in index.collect()}
    assert sorted((k, r["order"], r.page, r.label, r.block_ids, r["from"], r["to"], r.chars) for k, r in got.items()) == [
        (("p", "P01"), 1, 1, "安装 步骤", ["b1", "b2"], 0.0, 5.0, 29), (("p", "P02"), 3, 2, "x", ["b1"], 9.0, 8.0, 0), (("p", "part_002"), 2, None, "字幕", [], 0.0, 0.0, 12), (("q", "part_001"), 1, None, "x", [], 0.0, 0.0, 0),
    ]
    first = got["p", "P01"]
    assert first.terms == ["API", "key", "打开终端", "点击安装", "注意权限", "输入", "运行"] and first.commands == ["API", "key"]
    assert first.topic == "打开终端" and first.role == "operation_steps" and first.risk_points == ["注意权限"]
    assert (got["p", "part_002"].noise, got["p", "P02"].topic, got["p", "P02"].summary_points) == ("high", "x", [])
    merges = indexes.merge_candidates(index, "k").collect()
    assert merges == []
    concepts = {(r.k, r.concept): r.block_ids for r in indexes.concept_index(spark.createDataFrame([("p", "b1", "一 二三 四五。二三"), ("p", "b0", "四五"), ("p", "b2", None)], "k string, block_id string, text string"), "k").collect()}
    assert concepts == {("p", "二三"): ["b1"], ("p", "四五"): ["b0", "b1"]}
