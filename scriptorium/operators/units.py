"""Units of text out of raw sources of several shapes, the input of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sentences import compact_sentences
from ..functions.text import estimate_tokens, strip
from .packing import pack_entries

_ENTRY = "array<struct<content: string, from: string, to: string>>"
_TRACK = f"array<struct<lang: string, entries: {_ENTRY}, page_segments: array<struct<label: string, entries: {_ENTRY}>>>>"
# Labels of a plain text, of a segment without label, and of a track without language.
PLAIN, UNNAMED, TRACK = "原始文本", "未命名分段", "字幕内容"


def source_units(sources: DataFrame, key: str, source: str, target: int = 260) -> DataFrame:
    """key, track, segment, pack, label, text, start, end, tokens: units of raw sources given as JSON texts.

    A JSON string is a plain text, packed by sentences; a list holds subtitle tracks; an object holds tracks in
    ``subtitles`` or else a plain text in ``text``.  Of a track with page segments only these are read, each
    under its label, else its own entries under its language; entries are packed to ``target`` characters.
    A source of another shape, or none, has no units (``unread`` lists them).
    """
    read = _read(sources, key, source)
    # no filters on what is read: they would go down to the scan and parse each source once more; no text has no sentences
    plain = read.select(key, F.posexplode(compact_sentences(F.col("text"), target)).alias("pack", "text"))
    plain = plain.select(key, F.lit(0).alias("track"), F.lit(0).alias("segment"), (F.col("pack") + 1).alias("pack"), F.lit(PLAIN).alias("label"), "text", F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"))
    # nor those that an explode of a column brings with it
    tracks = read.select(key, F.posexplode(F.coalesce("tracks", F.array().cast(_TRACK))).alias("track", "t"))
    whole = F.array(F.struct(F.when(F.coalesce(F.col("t.lang"), F.lit("")) == "", TRACK).otherwise(F.col("t.lang")).alias("label"), F.col("t.entries").alias("entries")))
    paged = F.transform("t.page_segments", lambda s: F.struct(F.when(F.coalesce(s["label"], F.lit("")) == "", UNNAMED).otherwise(s["label"]).alias("label"), s["entries"].alias("entries")))
    segments = tracks.select(key, "track", F.posexplode(F.when(F.size("t.page_segments") > 0, paged).otherwise(whole)).alias("segment", "s"))
    entries = segments.select(key, "track", "segment", strip(F.col("s.label")).alias("label"), F.posexplode("s.entries").alias("at", "e"))
    entries = entries.select(key, "track", "segment", "label", "at", F.col("e.content").alias("text"), F.col("e.from").try_cast("double").alias("from"), F.col("e.to").try_cast("double").alias("to"))
    packed = pack_entries(entries, [key, "track", "segment", "label"], "at", "text", "from", "to", target).drop("entries")
    return plain.unionByName(packed).withColumn("tokens", estimate_tokens(F.col("text")))


def unread(sources: DataFrame, key: str, source: str) -> DataFrame:
    """Keys of sources that are no text, list or object with either."""
    return _read(sources, key, source).where("text is null and tracks is null").select(key)


def _read(sources: DataFrame, key: str, source: str) -> DataFrame:
    first = F.left(F.ltrim(F.col(source)), F.lit(1))
    object_ = F.from_json(F.when(first == "{", F.col(source)), f"text string, subtitles {_TRACK}")
    rows = sources.select(key, F.col(source).alias("source"), object_.alias("o"), F.from_json(F.when(first == "[", F.col(source)), _TRACK).alias("list"), F.when(first == '"', F.get_json_object(F.concat(F.lit('{"a":'), F.col(source), F.lit("}")), "$.a")).alias("string"))
    listed = F.coalesce("list", "o.subtitles")
    # where there is a list, there is neither an object nor a string
    return rows.select(key, listed.alias("tracks"), F.when(F.col("o.subtitles").isNull(), F.coalesce("string", "o.text")).alias("text"))
