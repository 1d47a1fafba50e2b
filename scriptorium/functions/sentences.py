"""Column functions over the sentences of a text: points, packs, keyword sentences, unique texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_whitespace, strip, truncate

# Where points, sentences and packs are cut.
DOT = r"(?<![A-Za-z0-9])\.(?![A-Za-z0-9])"
POINTS = rf"[；;。！？!?\n]|{DOT}|(?<=[^0-9])[、，,](?=[^0-9])"
SENTENCES = rf"[。！？!?\n]|{DOT}"
ENDS = r"(?<=[。！？!?；;])\s*|\n+"


def take_unique(texts: Column, limit: int) -> Column:
    """The first ``limit`` texts, normalised, that are not empty and differ by more than case (ß is ss); null is an empty array."""
    folded = lambda x: F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))

    def step(kept: Column, x: Column) -> Column:
        skip = (x == "") | (F.size(kept) >= limit) | F.exists(kept, lambda k: folded(k) == folded(x))
        return F.when(skip, kept).otherwise(F.concat(kept, F.array(x)))

    plain = F.transform(F.coalesce(texts, F.array().cast("array<string>")), normalize_whitespace)
    return F.aggregate(plain, F.array().cast("array<string>"), step)


def brief_points(text: Column, limit: int = 4) -> Column:
    """The first points of a text: parts between ends of sentences, lone dots and commas that part no digits."""
    return take_unique(F.split(normalize_whitespace(text), POINTS), limit)


def keyword_sentences(text: Column, keywords: tuple[str, ...], limit: int = 6, most: int = 140) -> Column:
    """The first ``limit`` sentences with a keyword, each cut to ``most`` characters; repeats among them go afterwards."""
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCES), lambda s: truncate(normalize_whitespace(s), most))
    hit = lambda s: F.greatest(*(F.contains(F.lower(s), F.lit(k.lower())) for k in (*keywords, *keywords[:1])))
    return take_unique(F.slice(F.filter(cut, lambda s: (s != "") & hit(s)), 1, limit), limit)


def compact_sentences(text: Column, target: int) -> Column:
    """Sentences packed to ``target`` characters: one opens a new pack if it would take a non-empty one over that."""
    pieces = F.filter(F.transform(F.split(normalize_whitespace(text), ENDS), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("pack"), F.lit(0).alias("held"))

    def step(s: Column, x: Column) -> Column:
        some = s["pack"] != ""
        full = some & (s["held"] + F.length(x) > target)
        return F.struct(
            F.when(full, F.concat(s["out"], F.array(s["pack"]))).otherwise(s["out"]).alias("out"),
            F.when(full | ~some, x).otherwise(F.concat(s["pack"], F.lit(" "), x)).alias("pack"),
            F.when(full, F.length(x)).otherwise(s["held"] + F.length(x)).alias("held"),
        )

    return F.aggregate(pieces, start, step, lambda s: F.when(s["pack"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["pack"]))))
