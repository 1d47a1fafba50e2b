"""Gates and checks of summaries, artifacts and cleaned texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import without_thoughts
from .text import strip

# Phrases of a model that talks about its task, and the signs a text may end with.
SELF_TALK = "(?:我现在需要|首先[,，]?我(?:会|要)|接下来[,，]?我|用户希望|用户要求|我会通读|我需要确保|需要注意的是|现在我来|下面我将|我要仔细阅读)"
CLEAN_END = r"[。！？.!?）)”》】\]`]$"
HEADING = r"(?m)^#{1,3}\s+\S+"


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in this order."""
    return F.array_compact(F.array(*(F.when(c, name) for c, name in pairs)))


def summary_route(mode: Column, ready: Column, seconds: Column, chars: Column, most_seconds: int = 1800, most_chars: int = 30_000) -> Column:
    """Whether a text is summed up, and what speaks against it; a forced mode overrules the reasons, a disabled one everything.  The codes of the reasons are this library's own."""
    off, forced = mode.isin("off", "none", "skip"), mode.isin("force", "on", "always")
    against = reasons((~ready, "missing_key"), (seconds > most_seconds, "duration_over_route"), (chars > most_chars, "content_over_route"), (off, "disabled"))
    return F.struct((~off & (forced | (F.size(against) == 0))).alias("eligible"), against.alias("reasons"))


def artifact_issues(text: Column, brief: Column, source_chars: Column) -> Column:
    """What is wrong with a written artifact; a brief of a long source must be longer."""
    body = strip(without_thoughts(text))
    least = F.when(brief, F.least(F.lit(1200), F.greatest(F.lit(600), F.floor(source_chars * 0.16)))).otherwise(500)
    return reasons((F.left(body, F.lit(900)).rlike(SELF_TALK), "self_talk"), (F.length(body) < least, "short"), (~body.rlike(HEADING), "no_heading"), (~body.rlike(CLEAN_END), "cut"))


def tolerated(n: Column, since: int) -> Column:
    """How many of ``n`` may be lost: none of a few, else 5 %, but one at least."""
    return F.when(n < since, 0).otherwise(F.greatest(F.lit(1), F.floor(n * 0.05))).cast("int")


def too_short(source_chars: Column, chars: Column) -> Column:
    """A cleaned text under three quarters of a source of over 800 characters, or under 240."""
    return (chars < F.greatest(F.lit(240), F.floor(source_chars * 0.75))) & (source_chars > 800)


def cleaning_issues(raw_chars: Column, chars: Column, raw_cjk: Column, cjk: Column) -> Column:
    """Length of a cleaned text against its source; one from another script may be much shorter."""
    least = F.when((raw_cjk < 0.12) & (cjk > 0.45), 0.24).otherwise(0.72)
    long, ratio = raw_chars > 800, chars / F.nullif(raw_chars, F.lit(0))
    return reasons((long & (ratio < least), "short"), (long & (ratio > 1.45), "long"))


def source_type(label: Column) -> Column:
    """Where a transcript comes from, by its label."""
    return (
        F.when(F.contains(F.lower(label), F.lit("sensevoice")) | F.contains(label, F.lit("本地")), "local_transcript")
        .when(F.contains(label, F.lit("转写")), "audio_transcript").when(F.contains(label, F.lit("字幕")), "bilibili_subtitle").otherwise("merged_text")
    )


# Notes to a writer, what of a list they name at most, and the bounds of a length.
NOTES = ("上一版缺少或改写关键数字/日期/术语：", "上一版缺少时间戳：", "上一版疑似新增原文不支持的完整年份：", "上一版输出偏短，疑似总结化；请保留更多有效信息", "上一版输出偏长，疑似扩写；请只清稿不补充", "上一版结构不适配 UP 类型：")
NAMED, NAMED_ISSUES, SHORT, LONG = 12, 4, 0.72, 1.45


def repair_notes(terms: Column, markers: Column, years: Column, ratio: Column, issues: Column, least: Column | None = None) -> Column:
    """What to mend in a text: missing terms and time marks, years without support, its length, its structure.

    Lists that are null or empty give no note; a missing ratio is 1, a missing least one 0.72.
    """
    named = lambda note, of, most, by: F.when(F.size(F.coalesce(of, F.array().cast("array<string>"))) > 0, F.concat(F.lit(note), F.array_join(F.slice(of, 1, most), by)))
    ratio, least = F.coalesce(ratio, F.lit(1.0)), F.coalesce(F.lit(None).cast("double") if least is None else least, F.lit(SHORT))
    return F.array_compact(
        F.array(
            *(named(note, of, NAMED, ", ") for note, of in zip(NOTES, (terms, markers, years), strict=False)),
            F.when(ratio < least, NOTES[3]), F.when(ratio > LONG, NOTES[4]), named(NOTES[5], issues, NAMED_ISSUES, "；"),
        )
    )
