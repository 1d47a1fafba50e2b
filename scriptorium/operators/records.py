"""Records kept in several places: overlays, caches, manifests, deletions that cascade, results that come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaid(incoming: Column, existing: Column, field: str, default: Column | None = None) -> Column:
    """A field of a JSON record laid over an older one.

    With a default, a null counts as missing; without, a null that is stated stays a null.
    """
    new, old = (F.get_json_object(x, f"$.{field}") for x in (incoming, existing))
    if default is not None:
        return F.coalesce(new, old, default)
    stated = F.coalesce(F.array_contains(F.json_object_keys(incoming), field), F.lit(False))
    return F.when(stated, new).otherwise(old)


def cache_hits(wanted: DataFrame, cached: DataFrame, keys: list[str], size: str, order: str) -> DataFrame:
    """``wanted`` with ``size`` of the latest cached row that agrees in all keys, and ``hit``; an empty one is a miss."""
    latest = cached.groupBy(*keys).agg(F.max_by(size, order).alias(size))
    found = wanted.join(latest, keys, "left").withColumn(size, F.coalesce(size, F.lit(0)))
    return found.withColumn("hit", F.col(size) > 0)


def whole(manifest: DataFrame, files: DataFrame, group: str, file: str) -> DataFrame:
    """Per group: number of files and whether all of them exist."""
    there = files.select(file).distinct().withColumn("__there", F.lit(True))
    return manifest.join(there, file, "left").groupBy(group).agg(F.count("*").alias("files"), F.bool_and(F.coalesce("__there", F.lit(False))).alias("valid"))


def without_packages(rows: DataFrame, gone: DataFrame, path: Column, source: Column) -> DataFrame:
    """``rows`` with ``removed``: those whose package, as a path or by its source id, is in ``gone`` (path, source)."""
    paths = gone.select(F.col("path").alias("__path")).where("__path <> ''").distinct().withColumn("__a", F.lit(True))
    sources = gone.select(F.col("source").alias("__source")).where("__source <> ''").distinct().withColumn("__b", F.lit(True))
    keyed = rows.withColumns({"__path": path, "__source": source})
    out = keyed.join(paths, "__path", "left").join(sources, "__source", "left")
    return out.withColumn("removed", F.col("__a").isNotNull() | F.col("__b").isNotNull()).drop("__path", "__source", "__a", "__b")


def collected(meta: DataFrame, results: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, state and the first result of each: done, missing (no result) or unknown (no such item); later results of an item are dropped."""
    first = results.groupBy(key).agg(F.min(F.struct(*order)).alias("result"))
    both = meta.select(key).distinct().withColumn("__known", F.lit(True)).join(first, key, "full")
    state = F.when(F.col("__known").isNull(), "unknown").when(F.col("result").isNull(), "missing").otherwise("done")
    return both.select(key, state.alias("state"), "result.*")


def outline(rows: DataFrame, group: str, order: str, title: str, lesson: str, chapters: int = 12, lessons: int = 8) -> DataFrame:
    """Chapters of a group in order of their first lesson: number, title, count and the first lessons; the first ``chapters`` only."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(group, title).orderBy(order)))
    few = F.array_sort(F.collect_list(F.when(F.col("__n") <= lessons, F.struct(F.col(order).alias("at"), F.col(lesson).cast("string").alias("name")))))
    found = ranked.groupBy(group, title).agg(F.min(order).alias("__first"), F.count("*").alias("n"), few.alias("__few"))
    numbered = found.withColumn("chapter", F.row_number().over(Window.partitionBy(group).orderBy("__first"))).where(F.col("chapter") <= chapters)
    return numbered.select(group, "chapter", title, "n", F.array_join(F.transform("__few", lambda x: x["name"]), "|").alias("lessons"))


PAGE = "struct<page:int,label:string,entries:array<string>>"
CACHE = f"struct<pages:map<string,{PAGE}>,subtitles:array<struct<page_segments:array<struct<label:string,entries:array<string>>>>>>"


def cached_pages(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """key, page, label, entries of transcript caches: pages by number, or segments of tracks whose label names the page.

    A segment without a page number is dropped; of segments with the same number the last counts.
    """
    parsed = rows.select(key, F.from_json(payload, CACHE).alias("c"))
    keyed = parsed.where("c.pages is not null").select(key, F.explode("c.pages").alias("no", "p")).where("p is not null")
    keyed = keyed.select(key, F.coalesce(F.nullif("p.page", F.lit(0)), F.col("no").try_cast("int")).alias("page"), F.coalesce("p.label", F.concat(F.lit("P"), "no")).alias("label"), "p.entries")
    segments = parsed.where("c.pages is null").select(key, F.posexplode("c.subtitles").alias("i", "t")).select(key, "i", F.posexplode("t.page_segments").alias("j", "s"))
    number = F.regexp_extract("s.label", r"P(\d+)", 1).try_cast("int")
    segments = segments.select(key, number.alias("page"), F.struct("i", "j", F.col("s.label").alias("label"), F.col("s.entries").alias("entries")).alias("s")).where("page > 0")
    segments = segments.groupBy(key, "page").agg(F.max_by("s", F.struct("s.i", "s.j")).alias("s")).select(key, "page", "s.label", "s.entries")
    return keyed.unionByName(segments).select(key, "page", "label", F.coalesce("entries", F.array().cast("array<string>")).alias("entries"))


def track(pages: DataFrame, key: str) -> DataFrame:
    """Pages with entries in the order of their numbers, with the place of their first entry in the track."""
    n = F.size("entries")
    before = F.sum(n).over(Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    return pages.where(n > 0).withColumn("place", F.coalesce(before, F.lit(0)))
