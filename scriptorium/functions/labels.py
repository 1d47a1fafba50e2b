"""Column functions for display and for cleaning what models and users write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK, SPACE, WHITE, strip

#: Fixed value: what parts the tokens of a material.
TOKEN_BREAKS = rf"[，。、“”‘’：；（）()\[\]【】、《》{SPACE}/]+"
#: The number of a page, and page numbers before a title.
PAGE_NUMBER = r"P(\d+)"
PAGE_PREFIX = rf"^(?:P?\p{{Nd}}+[.\-、：:{SPACE}]*)+"
#: Fixed value: the characters of one script that tell a language.
HAN = "[一-鿿]"
#: Fixed value: what no outgoing text may hold.
FORBIDDEN = r"(?i)<think\b|</think>|api[\s_-]?key|cookie|authorization|bearer\s+[a-z0-9._-]+|smtp\s*password|smtp授权|授权码"
#: Fixed value: what a rejected summary holds.
REJECTED = "(?i)request was rejected|considered high risk|cannot read properties"


def text_of(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def tokens(text: Column) -> Column:
    """Parts between punctuation, of two characters or more."""
    return F.filter(F.split(text_of(text), TOKEN_BREAKS), lambda x: F.length(x) >= 2)


def page_number(label: Column) -> Column:
    """The number after the first P, or 0."""
    return F.coalesce(F.nullif(F.regexp_extract(text_of(label), PAGE_NUMBER, 1), F.lit("")).try_cast("int"), F.lit(0))


def without_page(title: Column) -> Column:
    """The title without leading page numbers; unchanged if nothing else is left."""
    plain = strip(title)
    return F.coalesce(F.nullif(F.regexp_replace(plain, PAGE_PREFIX, ""), F.lit("")), plain)


def fence_body(text: Column) -> Column:
    """What a code fence around the whole text holds, else the text."""
    plain, fence = strip(text), r"(?is)^```(?:json|markdown|md)?\s*(.*?)\s*```$"
    return F.when(plain.rlike(fence), strip(F.regexp_extract(plain, fence, 1))).otherwise(plain)


def without_thoughts(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text_of(text), r"(?is)<think\b[^>]*>.*?</think>", ""), r"(?i)</?think\b[^>]*>", ""))


def plain_markdown(text: Column) -> Column:
    """Without code, images, link targets and marks, in one line."""
    t = F.regexp_replace(F.regexp_replace(text_of(text), r"(?s)```.*?```", " "), r"!\[[^\]]*\]\([^)]*\)", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\[([^\]]+)\]\([^)]*\)", "$1"), r"[#>*_`~|:-]", " ")
    return F.trim(F.regexp_replace(t, WHITE, " "))


def clipped(text: Column, budget: int, notice: str) -> Column:
    plain = strip(text)
    return F.when(F.length(plain) <= budget, plain).otherwise(F.concat(F.left(plain, F.lit(budget)), F.lit(notice)))


def secret(value: Column) -> Column:
    """A secret of printable ASCII, or nothing."""
    plain = strip(value)
    return F.when(plain.rlike(r"^[\x20-\x7e]+$"), plain).otherwise("")


def cjk_share(text: Column) -> Column:
    t = text_of(text)
    return F.when(t == "", 0.0).otherwise(F.regexp_count(t, F.lit(CJK)) / F.length(t))


def guessed_language(text: Column) -> Column:
    """zh if there are 8 CJK characters and no fewer than Latin letters, else null."""
    t = text_of(text)
    return F.when(F.regexp_count(t, F.lit(HAN)) >= F.greatest(F.lit(8), F.regexp_count(t, F.lit("[A-Za-z]"))), "zh")


def usable_summary(text: Column) -> Column:
    plain = strip(text)
    return (F.length(plain) >= 120) & ~plain.rlike(REJECTED)


def path_segment(text: Column, fallback: str, most: int = 120) -> Column:
    """A file name of one line without reserved characters and trailing dots."""
    t = F.regexp_replace(F.regexp_replace(text_of(text), r'[<>:"/\\|?*\x00-\x1F]', " "), WHITE, " ")
    return F.trim(F.left(F.coalesce(F.nullif(F.trim(F.regexp_replace(t, "[. ]+$", "")), F.lit("")), F.lit(fallback)), F.lit(most)))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def decimals(value: Column, n: Column | int) -> Column:
    """A double at ``n`` (0, 1 or 2) decimals: its exact value is rounded, and a tie, which only odd multiples of 1/2, 1/4 or 1/8 are, goes up."""

    def shown(of: Column) -> Column:
        x, d = of["x"], of["d"]
        steps = x * F.element_at(F.array(F.lit(2.0), F.lit(4.0), F.lit(8.0)), d + 1)
        tie = (steps == F.floor(steps)) & (F.pmod(steps, F.lit(2.0)) == 1)
        return F.replace(F.call_function("format_number", F.when(tie, x + 0.001).otherwise(x), F.element_at(F.array(F.lit("0"), F.lit("0.0"), F.lit("0.00")), d + 1)), F.lit(","), F.lit(""))

    return let(F.struct(value.alias("x"), (F.lit(n) if isinstance(n, int) else n).alias("d")), shown)


def compact_number(value: Column) -> Column:
    """Hundreds of millions with two decimals, tens of thousands with one, rounded from the exact value of the double, ties upwards."""
    large, middle = F.concat(decimals(value / 1e8, 2), F.lit(" 亿")), F.concat(decimals(value / 1e4, 1), F.lit(" 万"))
    return F.when(value > 0, F.when(value >= 1e8, large).when(value >= 1e4, middle).otherwise(F.floor(value + 0.5).cast("string"))).otherwise("0")


def byte_size(value: Column) -> Column:
    """B, KB, MB or GB; whole from 10 of a unit on, one decimal below except of bytes."""
    k = F.when(value >= 1024.0**3, 3).when(value >= 1024.0**2, 2).when(value >= 1024.0, 1).otherwise(0)

    def shown(of: Column) -> Column:
        size, unit = of["size"], of["k"]
        return F.concat(decimals(size, F.when((size >= 10) | (unit == 0), 0).otherwise(1)), F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit + 1))

    return F.when(value > 0, let(F.struct((value / F.pow(F.lit(1024.0), k)).alias("size"), k.alias("k")), shown)).otherwise("0 B")


def elapsed(value: Column) -> Column:
    """s, m s, or h m."""
    minutes, seconds = F.floor(value / 60), F.floor(value % 60 + 0.5)
    hours, rest = F.floor(minutes / 60), minutes % 60
    two = lambda a, x, b, y: F.when(y > 0, F.format_string(f"%d{a} %d{b}", x, y)).otherwise(F.format_string(f"%d{a}", x))
    return F.when(~(value > 0) | value.isNull(), "").when(value < 60, F.format_string("%ds", F.floor(value + 0.5))).when(minutes < 60, two("m", minutes, "s", seconds)).otherwise(two("h", hours, "m", rest))


def duration_text(seconds: Column) -> Column:
    """h:mm:ss or m:ss; empty for none."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(~(s > 0) | s.isNull(), "").when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def bar_percent(value: Column, largest: Column) -> Column:
    """8 to 100 of the largest; 0 for none."""
    return F.when(value > 0, F.greatest(F.lit(8), F.least(F.lit(100), F.floor(value / F.greatest(F.lit(1.0), largest) * 100 + 0.5).cast("int")))).otherwise(0)


def ago(ms: Column) -> Column:
    """How long ago, for spans below a week; empty beyond."""
    unit = lambda size, name: F.format_string(f"%d {name}", F.greatest(F.lit(1), F.floor(ms / size + 0.5).cast("int")))
    return F.when(ms < 60_000, "刚刚继续过").when(ms < 3_600_000, unit(60_000, "分钟前")).when(ms < 86_400_000, unit(3_600_000, "小时前")).when(ms < 7 * 86_400_000, unit(86_400_000, "天前")).otherwise("")
