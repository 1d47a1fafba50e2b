"""Cleaning and extraction, traced by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import labels as L
from scriptorium.functions import numbers as N
from scriptorium.functions import text as X
from scriptorium.operators import chunking, packing


@pytest.fixture(scope="module")
def of(spark):
    def run(column, *texts):
        names = [f"t{i}" for i in range(len(texts))]
        return spark.createDataFrame([texts], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("r")).first().r

    return run


def test_rule_clean(of):
    assert of(X.rule_clean, "嗯，今天天气好。\n今天") == "今天天气好。今天"
    assert of(X.rule_clean, "A\n\nA") == "A"
    assert of(X.rule_clean, None) == ""


def test_numeric_terms(of):
    assert of(X.numeric_terms, "2001年2002年 12.5% 3月4日") == ["2001年", "2002年", "3月4日", "12.5%"]
    assert of(X.full_years, "1999年 1999") == ["1999年"]
    assert of(lambda a, b: X.missing_terms(X.numeric_terms(a), b), "12.5% 2001", "about 12.5%") == ["2001"]


def test_years_that_the_source_lacks(of):
    assert of(X.unsupported_years, "938年", "1938年") == []
    assert of(X.unsupported_years, "1938年与938年", "1938年 1999年 2001") == ["1999年", "2001"]
    assert of(X.unsupported_years, None, "2001年2002年") == ["2001年", "2002年"]


def test_markers(of):
    assert of(X.missing_markers, "[00:10-00:20] [00:30-00:40]", "[00:10-00:20]") == ["[00:30-00:40]"]
    assert of(X.missing_markers, "[00:10-00:20]", "") == []
    assert of(X.missing_markers, None, None) == []


def test_white_space_of_any_script_goes(of):
    assert of(X.normalize_whitespace, "　a  b\r\n ") == "a b"


def test_durations(of):
    for text, seconds in (("1:02:03", 3723), ("5:xx", 0), ("", 0), ("90", 90), ("1::3", 3603), (None, 0)):
        assert of(N.duration_seconds, text) == seconds


def test_entries_lose_their_line_feeds(spark):
    rows = spark.createDataFrame([("p", 1, "\nabc\n", 0.0, 1.0), ("p", 2, "defg", 1.0, None), ("p", 3, " \n", 5.0, 9.0), ("p", 4, "hijklmnop", None, 4.0)], "p string, i int, t string, a double, b double")
    got = sorted((r.pack, r.text, r.start, r.end) for r in packing.pack_entries(rows, "p", "i", "t", "a", "b", 7).collect())
    assert got == [(1, "abc defg", 0.0, 1.0), (2, "hijklmnop", None, 4.0)]
    rows = spark.createDataFrame([("p", i, t, 0.0, 1.0) for i, t in enumerate(("abc", "def", "ghi", "abcdefghi"))], "p string, i int, t string, a double, b double")
    assert [r.text for r in packing.pack_entries(rows, "p", "i", "t", "a", "b", 7).orderBy("pack").collect()] == ["abc def", "ghi", "abcdefghi"]


def test_short_tail_counts_its_joints(spark):
    def blocks(sizes, target, most, least):
        rows = spark.createDataFrame([("p", i, n) for i, n in enumerate(sizes)], "p string, i int, n int")
        return sorted((r.first, r.last) for r in chunking.block_ranges(rows, ["p"], "i", "n", target, most, least).collect())

    # the text of the tail is 4 + 2 + 4 long, so it stays
    assert blocks([12, 10, 4, 4], 20, 30, 10) == [(1, 2), (3, 4)]
    assert blocks([12, 10, 4, 3], 20, 30, 10) == [(1, 4)]
    assert blocks([12, 10, 15, 5], 20, 30, 10) == [(1, 2), (3, 4)]
    assert blocks([22, 5], 20, 30, 10) == [(1, 2)]


def test_labels(of, spark):
    assert of(L.without_thoughts, "<think>a\nb</think>\n# X") == "# X"
    assert of(lambda t: L.path_segment(t, "x"), "标题含非法字符: <> / \\ | ? * 但应该保留主要文字") == "标题含非法字符 但应该保留主要文字"
    shown = spark.createDataFrame([(0.0,), (500.0,), (2048.0,), (1.5e7,), (5e9,)], "v double").select(L.byte_size(F.col("v")).alias("r")).collect()
    assert [r.r for r in shown] == ["0 B", "500 B", "2.0 KB", "14 MB", "4.7 GB"]


def test_shown_numbers_round_the_exact_double(spark):
    """Not the shortest decimal of the double; ties, which only some dyadic fractions are, go up."""
    shown = {1.005e8: "1.00 亿", 1.015e8: "1.01 亿", 2.505e8: "2.51 亿" if 2.505 > 2505 / 1000 else "2.50 亿", 1.125e8: "1.13 亿", 12_500: "1.3 万", 10_500: "1.1 万", 0: "0", 9_999.5: "10000"}
    rows = spark.createDataFrame([(float(k),) for k in shown], "v double").select("v", L.compact_number(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == {float(k): v for k, v in shown.items()}
    sizes = {0.0: "0 B", 512.0: "512 B", 1536.0: "1.5 KB", 1024.0 * 1.25: "1.3 KB", 10.5 * 1024: "11 KB", 5.0 * 2**30: "5.0 GB"}
    rows = spark.createDataFrame([(k,) for k in sizes], "v double").select("v", L.byte_size(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == sizes


def test_unicode_space_and_wide_cjk(spark):
    row = spark.createDataFrame([("P1　标题", "你好　世界", "㐀㐁", "x")], "a string, b string, c string, d string").select(
        L.without_page(F.col("a")), L.tokens(F.col("b")), L.cjk_share(F.col("c")), L.guessed_language(F.repeat("c", F.lit(9)))).first()
    assert list(row) == ["标题", ["你好", "世界"], 1.0, None]


@pytest.mark.parametrize(
    "source, cleaned, softened",
    [
        ("", "1998年5月6日星期日开会", "5月6日开会"), ("1998", "1998年5月6日星期日开会", "1998年5月6日星期日开会"), ("998年", "1998 年", "1998 年"), ("", "2001年和2001", "当时和当时"),
        ("", "编号 20015 与 2001年", "编号 20015 与 当时"), ("2001年", "2001年到2002年", "2001年到当时"), (None, "1999", "当时"), ("x", None, ""), (None, "", ""), ("", "无年份 123", "无年份 123"),
    ],
)
def test_years_that_nothing_supports(spark, source, cleaned, softened):
    rows = spark.createDataFrame([(source, cleaned)], "s string, c string")
    assert rows.select(X.soften_years(F.col("s"), F.col("c"))).first()[0] == softened


def softened(source, text):
    """Year by year with patterns of its own."""
    for year in dict.fromkeys(y[:4] for y in re.findall(r"(?<![0-9])(?:19|20)[0-9]{2}年?", text)):
        if year in source or year[1:] + "年" in source:
            continue
        text = re.sub(year + r"年(\d{1,2}月\d{1,2}日)(?:星期[一二三四五六日天])?", r"\1", text)
        text = re.sub(year + "年", "当时", text)
        text = re.sub(rf"(?<!\d){year}(?!\d)", "当时", text)
    return text


def test_years_of_random_texts(spark):
    deal = random.Random(3)
    bits = ["2020", "2021", "1919", "202", "20", "19", "1", "٣", "年", "年", "5月", "12月", "6日", "5月6日", "星期日", "当时", " ", "x", "\ue000", "\ue001", "\ue002", "\ue003", "$1", "\\"]
    rows = [("".join(deal.choices(bits, k=deal.randrange(4))), "".join(deal.choices(bits, k=deal.randrange(1, 14)))) for _ in range(4000)]
    got = spark.createDataFrame(rows, "s string, c string").select("s", "c", X.soften_years(F.col("s"), F.col("c")).alias("r")).collect()
    assert [(r.s, r.c, r.r) for r in got] == [(s, c, softened(s, c)) for s, c in rows]
    assert any(r.r != r.c for r in got)


def test_years_are_sought_once(spark):
    """A text of many years is read once, not once a year."""
    rows = spark.createDataFrame([("1999", "1998年5月6日，1999")], "s string, c string")
    for column in (X.soften_years(F.col("s"), F.col("c")), X.unsupported_years(F.col("s"), F.col("c"))):
        plan = rows.select(column.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == 1


def test_forms_of_years(spark):
    row = spark.createDataFrame([("2001 2002年 2001年 32003 2002 2004年", "002年")], "c string, s string").select(X.full_years(F.col("c")), X.unsupported_years(F.col("s"), F.col("c"))).first()
    assert list(row) == [["2001", "2002年", "2004年"], ["2001", "2004年"]]
