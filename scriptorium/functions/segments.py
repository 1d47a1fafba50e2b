"""Transcripts without times cut into segments, as an Arrow column function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a transcript may part, where a text without sentences may be cut, and the sizes of a segment.
PART = re.compile(r"(?<=[。！？!?；;])\s*|(?<=，)\s+")
CUT = re.compile("[，,。！？!?；;、 ]")
TARGET, MOST = 90, 120


def rough_parts(text: str, target: int = TARGET, most: int = MOST) -> list[str]:
    """Sentences of a text; of a single one, cuts at a mark from ``target`` characters on, or at ``most``."""
    parts = [p for p in map(str.strip, PART.split(text)) if p]
    if len(parts) > 1:
        return parts
    out, at = [], 0
    while at < len(text):
        mark = CUT.search(text, at + target - 1, at + most)
        end = mark.end() if mark else min(len(text), at + most)
        out.append(text[at:end].strip())
        at = end
    return [p for p in out if p]


def packed(parts: list[str], target: int = TARGET, most: int = MOST) -> list[str]:
    """Parts joined to segments: one closes before a part that would take it over ``most``, and once it holds ``target``."""
    out, held = [], ""
    for part in parts:
        if held and len(held) + len(part) > most:
            out.append(held)
            held = ""
        held += part
        if len(held) >= target:
            out.append(held)
            held = ""
    return [*out, held] if held else out


def split_transcript(text: str | None, target: int = TARGET, most: int = MOST) -> list[str]:
    plain = re.sub(r"\s+", " ", text or "").strip()
    return packed(rough_parts(plain, target, most), target, most)


def transcript_segments(text: Column, target: int = TARGET, most: int = MOST) -> Column:
    """The segments of a transcript, in order; none of a blank or null one.  Each text is scanned once."""

    @F.pandas_udf("array<string>")
    def segments(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_transcript(t, target, most))

    return segments(text)


def timed_entries(segments: Column, chars: Column, offset: Column, duration: Column) -> Column:
    """from, to, content of each segment: the duration shared out by length, a fifth of a second at least, the last up to the end.

    Without a duration it is a seventh of a second for each of ``chars``, the characters of the text, or four seconds a segment if that is more.
    The segments must be a column of their own, not the call that makes them.
    """
    n = F.size(segments)
    whole = F.when(duration > 0, duration).otherwise(F.greatest(chars / F.lit(7.0), n * F.lit(4.0)))
    sizes = F.transform(segments, F.length)
    total = F.greatest(F.lit(1), F.aggregate(sizes, F.lit(0), lambda a, x: a + x))
    kind = "array<struct<from:double,to:double,content:string>>"
    start = F.struct(F.lit(0).alias("before"), F.array().cast(kind).alias("out"))
    at = lambda chars_: offset.cast("double") + whole * chars_ / total

    def step(s: Column, i: Column) -> Column:
        text = F.get(segments, i)
        upto = s["before"] + F.length(text)
        end = F.when(i == n - 1, offset + whole).otherwise(at(upto))
        one = F.struct(at(s["before"]).alias("from"), F.greatest(end, at(s["before"]) + F.lit(0.2)).alias("to"), text.alias("content"))
        return F.struct(upto.alias("before"), F.concat(s["out"], F.array(one)).alias("out"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["out"])).otherwise(F.array().cast(kind))
