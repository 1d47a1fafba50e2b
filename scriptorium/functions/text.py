"""Column functions over transcript text: cleaning, counting, classifying, extracting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keyword lists that decide noise, roles and version sensitivity.
NOISE = ("点赞", "投币", "关注", "三连", "弹幕", "评论区", "直播间", "同学们好", "大家好", "废话不多说", "下期", "课程优惠", "加群")
OPERATION = ("打开", "点击", "选择", "输入", "复制", "粘贴", "保存", "运行", "执行", "安装", "配置", "启动", "创建", "导入", "连接", "检查", "验证")
TROUBLE = ("报错", "失败", "无法", "不能", "错误", "异常", "权限", "超时", "不通", "没有响应", "排查", "排错")
CASE = ("病例", "案例", "场景", "需求", "客户", "业务", "患者", "诊断", "鉴别")
EXAM = ("考试", "考点", "评分", "扣分", "得分", "真题", "题目", "答题")
TOOL = ("api", "key", "base url", "模型", "配置", "安装", "环境", "终端", "命令", "路径")
CONCEPT = ("概念", "原理", "为什么", "区别", "关系", "定义", "本质", "框架")
STRATEGY = ("策略", "计划", "复习", "路线", "方法", "选择", "取舍")
VERSION_TERMS = ("api", "sdk", "model", "版本", "价格", "额度", "openclaw", "langchain", "langgraph", "autogen", "crewai", "ragflow", "mcp", "tavily", "python", "node")
ROLES = {"tool_config": TOOL, "operation_steps": OPERATION, "troubleshooting": TROUBLE, "case_analysis": CASE, "exam_training": EXAM, "concept_explain": CONCEPT, "strategy": STRATEGY}
ACTION_ROLES = ("operation_steps", "tool_config", "troubleshooting", "case_analysis", "exam_training")


#: All that counts as white space, separators of files to units included: as a class, and as characters.
SPACE = r"\s\u000b\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = f"[{SPACE}]+"
SPACES = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """Without white space of any script at the ends; null is empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def normalize_whitespace(text: Column) -> Column:
    """Unify line ends, squeeze spaces and tabs, trim; line breaks stay."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    return strip(F.regexp_replace(text, "[ \t]+", " "))


_ENDS = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: The same in DuckDB's SQL, of a column ``text``.
CLEAN_SQL = rf"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^{_ENDS}|{_ENDS}$', '', 'g')"


def keyword_hits(text: Column, keywords: tuple[str, ...], lowered: bool = False) -> Column:
    """How many of the keywords occur (not how often)."""
    low = text if lowered else F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def noise_level(text: Column, plain: Column | None = None) -> Column:
    """``plain``: the text with normalised white space, where it is at hand."""
    hits, size = keyword_hits(text, NOISE), F.length(normalize_whitespace(text) if plain is None else plain)
    return F.when((hits >= 3) | ((hits > 0) & (size < 260)), "high").when(hits > 0, "medium").otherwise("low")


def noise_reasons(text: Column, most: int = 5) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.slice(F.filter(F.array(*map(F.lit, NOISE)), lambda k: F.contains(low, k)), 1, most)


def role(text: Column) -> Column:
    """The role with most keywords; the first of equals; a default without any."""
    scores = [F.struct(keyword_hits(text, ks).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("role")) for i, (name, ks) in enumerate(ROLES.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["role"]).otherwise("concept_explain")


def scored(size: Column, role_: Column, noise: Column) -> Column:
    """1 to 5 by length of the normalised text, role and noise."""
    score = 1 + F.least(F.lit(3), F.floor(size / 900)) + role_.isin(*ACTION_ROLES).cast("int")
    score = score - F.when(noise == "high", 2).when(noise == "medium", 1).otherwise(0)
    return F.greatest(F.lit(1), F.least(F.lit(5), score)).cast("int")


def teaching_score(text: Column) -> Column:
    return scored(F.length(normalize_whitespace(text)), role(text), noise_level(text))


def profiled(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with size, role and noise of a text; lower case and white space are normalised once, in a projection of their own."""
    own = [c for c in rows.columns if c != text]
    low = rows.select(*own, F.lower(F.coalesce(text, F.lit(""))).alias(text), F.length(normalize_whitespace(F.col(text))).alias("size"))
    found = low.select(*own, "size", keyword_hits(F.col(text), NOISE, lowered=True).alias("hits"), F.array(*(keyword_hits(F.col(text), ks, lowered=True) for ks in ROLES.values())).alias("scores"))
    most = F.array_max("scores")
    names = F.array(*map(F.lit, ROLES))
    role_ = F.when(most > 0, F.element_at(names, F.array_position("scores", most).cast("int"))).otherwise("concept_explain")
    noise = F.when((F.col("hits") >= 3) | ((F.col("hits") > 0) & (F.col("size") < 260)), "high").when(F.col("hits") > 0, "medium").otherwise("low")
    return found.select(*own, "size", role_.alias("role"), noise.alias("noise"))


# What counts as a CJK character and as a word, and the weight of each kind.
CJK, WORD = r"[\u3400-\u9fff]", "[A-Za-z0-9_]+"
PER_CJK, PER_WORD, PER_OTHER = 0.72, 1.15, 0.28


def estimate_tokens(text: Column) -> Column:
    """Weighted count of CJK characters, words and the rest; at least 1."""
    text = F.coalesce(text, F.lit(""))
    cjk, words = F.regexp_count(text, F.lit(CJK)), F.regexp_count(text, F.lit(WORD))
    other = F.length(F.regexp_replace(F.regexp_replace(text, CJK, ""), WORD, ""))
    return F.greatest(F.lit(1), F.ceil(cjk * PER_CJK + words * PER_WORD + other * PER_OTHER)).cast("long")


def block_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(text, F.lit(""))) * 10 / 17)).cast("long")


# Patterns of critical terms and of time markers.
NUMERIC = (
    r"(?<!\d)(?:19|20)\d{2}年?", r"(?<!\d)\d{1,2}月\d{1,2}日", r"(?<!\d)\d+(?:\.\d+)?%",
    r"(?<!\d)\d+(?:\.\d+)?(?:万|亿)?美元", r"(?<!\d)\d+(?:\.\d+)?(?:万|亿)人",
)
MARKER = r"\[(?:\d{1,2}:)?\d{2}:\d{2}-(?:\d{1,2}:)?\d{2}:\d{2}\]"


def numeric_terms(text: Column) -> Column:
    """Years, dates, percentages, sums and head counts, by pattern and then by place, each once."""
    text = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in NUMERIC)))


def missing_terms(terms: Column, cleaned: Column) -> Column:
    """Terms that the cleaned text does not contain as a substring."""
    return F.filter(terms, lambda t: ~F.contains(F.coalesce(cleaned, F.lit("")), t))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often and deep in lambdas it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _year(y: Column) -> Column:
    return F.left(y, F.lit(4))


def full_years(text: Column) -> Column:
    """Years, each once whether or not 年 follows (the first form stays)."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMERIC[0]), F.lit(0))
    first = lambda forms, years: F.transform(F.array_distinct(years), lambda y: F.element_at(forms, F.array_position(years, y).cast("int")))
    return _once(found, lambda forms: _once(F.transform(forms, _year), lambda years: first(forms, years)))


def unsupported_years(source: Column, cleaned: Column) -> Column:
    """Years of the cleaned text that the source lacks; a lost leading digit before 年 is forgiven."""
    lacks = lambda s, y: ~F.contains(s, _year(y)) & ~F.contains(s, F.concat(F.substring(y, 2, 3), F.lit("年")))
    return _once(F.coalesce(source, F.lit("")), lambda s: F.filter(full_years(cleaned), lambda y: lacks(s, y)))


# A private character with one of three after it: one of the text's own, a year with 年, a number of four digits.
_OWN, _DATED, _NUMBER = "\ue000\ue001", "\ue000\ue002", "\ue000\ue003"


def soften_years(source: Column, cleaned: Column) -> Column:
    """The cleaned text with its unsupported years gone: a month and day after one stay (without the weekday), else 当时 is put.

    Digits next to a number of the same four digits keep it, unless 年 follows.  Null is empty.
    """

    # a pattern with the year in it would be compiled anew for each row: marks stand for the year in fixed ones
    def without(t: Column, y: Column) -> Column:
        t = F.replace(t, F.concat(_year(y), F.lit("年")), F.lit(_DATED))
        t = F.regexp_replace(t, _DATED + r"(\p{Nd}{1,2}月\p{Nd}{1,2}日)(?:星期[一二三四五六日天])?", "$1")
        t = F.replace(t, F.lit(_DATED), F.lit("当时"))
        t = F.regexp_replace(t, r"(?<!\p{Nd})([0-9]{4})(?!\p{Nd})", _NUMBER + "$1")
        t = F.replace(t, F.concat(F.lit(_NUMBER), _year(y)), F.lit("当时"))
        return F.replace(t, F.lit(_NUMBER), F.lit(""))

    def softened(text: Column) -> Column:
        own = F.replace(text, F.lit(_OWN[0]), F.lit(_OWN))
        return F.aggregate(unsupported_years(source, text), own, without, lambda t: F.replace(t, F.lit(_OWN), F.lit(_OWN[0])))

    return _once(F.coalesce(cleaned, F.lit("")), softened)


def time_markers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MARKER), F.lit(0)))


def missing_markers(source: Column, cleaned: Column) -> Column:
    """Markers of the source that got lost; a source with fewer than two is not held to any."""
    found = time_markers(source)
    return F.when(F.size(found) < 2, F.array().cast("array<string>")).otherwise(missing_terms(found, cleaned))


def rule_clean(text: Column) -> Column:
    """Squeeze, join around punctuation, drop fillers, then drop lines that repeat the last non-blank one."""
    # fixed values: punctuation that takes no space before it, and fillers
    marks = "[，。！？；：、,.!?;:]"
    t = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "　", " "), "[ \t]+", " ")
    t = F.regexp_replace(t, rf"(?U)\s+({marks})", "$1")
    t = F.regexp_replace(t, rf"(?U)({marks})\s+", "$1")
    t = F.regexp_replace(t, r"(?U)\b(嗯|呃|啊|额)\b[，,、 ]*", "")
    lines = F.transform(F.split(t, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    # (kept text, last non-blank line, whether a blank line is pending)
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("last"), F.lit(False).alias("gap"))

    def step(s: Column, x: Column) -> Column:
        same, glue = (x == "") | (x == s["last"]), F.when(s["out"] == "", "").when(s["gap"], "\n\n").otherwise("\n")
        return F.struct(
            F.when(same, s["out"]).otherwise(F.concat(s["out"], glue, x)).alias("out"),
            F.when(same, s["last"]).otherwise(x).alias("last"),
            F.when(x == "", True).when(x == s["last"], s["gap"]).otherwise(False).alias("gap"),
        )

    return F.aggregate(lines, start, step, lambda s: s["out"])


def slug(text: Column, most: int = 48) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most))


def file_name(text: Column, most: int = 80) -> Column:
    """Reserved characters become underscores."""
    return F.left(F.regexp_replace(F.coalesce(text, F.lit("")), r'[\\/:*?"<>|]', "_"), F.lit(most))


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit - 1))), F.lit("…"))).otherwise(text)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def normalize_name(text: Column) -> Column:
    """Trimmed, single-spaced, lower-case name used to match creators."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
