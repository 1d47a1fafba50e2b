"""Terms of a text: names and short tokens, and those that must survive a rewriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import let, tokens
from .text import SPACES

# Words that are no terms, marks around a term, and what a name and a critical term look like.
STOPWORDS = ("这个", "那个", "然后", "就是", "我们", "你们", "大家", "可以", "需要", "一个", "一下", "如果", "因为", "所以", "其实", "现在", "这里", "里面", "时候", "内容", "课程", "视频", "字幕", "老师")
MARKS = "`'\"“”‘’.,，。:：;；()（）[]【】<>《》"
NAME = r"(?U)\b[A-Za-z][A-Za-z0-9_.+-]{1,31}\b"
CRITICAL = r"(?:19|20)\d{2}年?|\d+(?:\.\d+)?%|[A-Za-z][A-Za-z0-9.+-]{2,}|[一-龥]{2,}(?:模型|版本|芯片|框架|接口|按钮|命令|路径)"
COMMANDS = ("api", "key", "url", "model", "sdk", "mcp")


def extract_terms(text: Column, limit: int = 18) -> Column:
    """The first ``limit`` terms: names of three characters or with a capital, then tokens of 2 to 12 characters that are no numbers.

    Marks at the ends go; stopwords, digits, single letters and what is longer than 32 are left out; terms that differ by case
    only count once, in their first form.
    """
    text = F.coalesce(text, F.lit(""))
    names = F.filter(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), lambda t: (F.length(t) >= 3) | t.rlike("[A-Z]"))
    short = F.filter(tokens(text), lambda t: (F.length(t) <= 12) & ~t.rlike(r"^\p{Nd}+(?:\.\p{Nd}+)?$"))
    plain = F.transform(F.concat(names, short), lambda t: F.btrim(t, F.lit(MARKS)))
    good = F.filter(plain, lambda t: (t != "") & (F.length(t) <= 32) & ~t.isin(*STOPWORDS) & ~t.rlike(r"^(?:\p{Nd}+|[A-Za-z])$"))

    def first(of: Column) -> Column:
        low = F.transform(of, F.lower)
        return let(low, lambda ls: F.transform(F.slice(F.array_distinct(ls), 1, limit), lambda l: F.element_at(of, F.array_position(ls, l).cast("int"))))

    return let(good, first)


def commands(terms: Column, most: int = 10) -> Column:
    """Of terms those with a Latin letter or known as names of interfaces."""
    return F.slice(F.filter(terms, lambda t: t.rlike("[A-Za-z]") | F.lower(t).isin(*COMMANDS)), 1, most)


def critical_terms(text: Column, most: int = 80) -> Column:
    """Years, percentages, names and named things among the first ``most`` found, each once."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CRITICAL), F.lit(0))
    return F.array_distinct(F.slice(found, 1, most))


def spaced(text: Column) -> Column:
    """Without white space at the ends; null stays null."""
    return F.btrim(text, F.lit(SPACES))
