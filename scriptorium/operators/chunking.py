"""Chunks with overlap, blocks with a tail rule, and runs of related parts.

Each is a fold over the ordered rows of a package (``folds``) that holds the open chunk, block or run and
no more, so a package may be of any length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, strip
from .folds import fold


class Chunks:
    """Units packed by tokens: a chunk closes before a unit of another label, keeping nothing; before a unit that would
    take it over ``target``; and after a unit that took it over ``most``.  The latter two keep the last ``overlap``
    units for the next chunk.  At the end, kept units alone make no chunk; before another label or an overflow they do.
    """

    def __init__(self, target: int, most: int, overlap: int, show=lambda units: (units[0][0], units[-1][0])):
        self.target, self.most, self.overlap, self.show = target, most, overlap, show
        self.units: deque = deque()
        self.held, self.chunk, self.position, self.fresh = 0, 0, 0, False

    def _close(self, keep: int) -> tuple:
        self.chunk += 1
        row = (self.chunk, *self.show(self.units))
        while len(self.units) > keep:
            self.held -= self.units.popleft()[2]
        self.fresh = False
        return row

    def take(self, label, tokens, *rest) -> Iterator[tuple]:
        self.position += 1
        tokens = tokens or 0
        if self.units and self.units[-1][1] != label:
            yield self._close(0)
        if self.units and self.held + tokens > self.target:
            yield self._close(self.overlap)
        self.units.append((self.position, label, tokens, *rest))
        self.held, self.fresh = self.held + tokens, True
        if self.held > self.most:
            yield self._close(self.overlap)

    def end(self) -> Iterator[tuple]:
        if self.units and self.fresh:
            yield self._close(0)


def chunk_ranges(units: DataFrame, group: list[str], order: str, label: str, tokens: str, target: int, most: int, overlap: int) -> DataFrame:
    """group, chunk, first, last: ranges of unit positions (from 1) that make the chunks of each package (see ``Chunks``)."""
    return fold(units, group, [order], [label, tokens], lambda: Chunks(target, most, overlap), "chunk int, first int, last int")


def build_chunks(units: DataFrame, group: list[str], order: list[str], label: str, text: str, tokens: str, start: str, end: str, target: int = 5200, most: int = 6200, overlap: int = 4) -> DataFrame:
    """group, chunk, text, labels, start, end, units, tokens: the chunks of each package, whole (see ``Chunks``).

    The text has a heading for each label and then the texts of the units, a line each; its tokens are counted
    anew; start and end are the least and largest that any unit has.  An empty text stays a line; null is empty.
    """

    def show(held: deque) -> tuple:
        labels = list(dict.fromkeys(u[1] for u in held))
        header, body = "\n".join(f"## {x or ''}" for x in labels), "\n".join(u[3] or "" for u in held)
        starts, ends = [u[4] for u in held if u[4] is not None], [u[5] for u in held if u[5] is not None]
        return f"{header}\n\n{body}", labels, min(starts, default=None), max(ends, default=None), len(held)

    times = {start: F.col(start).cast("double"), end: F.col(end).cast("double")}
    chunks = fold(units.withColumns(times), group, order, [label, tokens, text, start, end], lambda: Chunks(target, most, overlap, show), "chunk int, text string, labels array<string>, start double, end double, units int")
    return chunks.withColumn("text", strip(F.col("text"))).withColumn("tokens", estimate_tokens(F.col("text")))


class Blocks:
    """A block closes once it holds ``target`` or if the next chunk would take it over ``most``; a last block whose
    text, chunks joined by two line feeds, has under ``least`` joins the one before it."""

    def __init__(self, target: int, most: int, least: int):
        self.target, self.most, self.least = target, most, least
        self.done: tuple[int, int] | None = None  # the block before the open one
        self.first, self.last, self.held, self.block = 1, 0, 0, 0

    def _shown(self) -> Iterator[tuple]:
        if self.done:
            self.block += 1
            yield (self.block, *self.done)

    def take(self, size) -> Iterator[tuple]:
        size = size or 0
        if self.last >= self.first and (self.held + size > self.most or self.held >= self.target):
            yield from self._shown()
            self.done, self.first, self.held = (self.first, self.last), self.last + 1, 0
        self.last, self.held = self.last + 1, self.held + size

    def end(self) -> Iterator[tuple]:
        if self.done and self.held + 2 * (self.last - self.first) < self.least:
            self.done = (self.done[0], self.last)
            yield from self._shown()
        else:
            yield from self._shown()
            self.done = (self.first, self.last)
            yield from self._shown()


def block_ranges(chunks: DataFrame, group: list[str], order: str, size: str, target: int, most: int, least: int) -> DataFrame:
    """group, block, first, last: blocks of chunks, by their positions from 1 (see ``Blocks``)."""
    return fold(chunks, group, [order], [size], lambda: Blocks(target, most, least), "block int, first int, last int")


class Merges:
    """A part joins the run before it if it has the same role and shares a term, whatever its case, with its neighbour, or the run is
    shorter than ``free``; a noisy part belongs to no run and ends one; a run of ``most`` is whole."""

    def __init__(self, most: int, free: int, keep: int):
        self.most, self.free, self.keep = most, free, keep
        self.position, self.size, self.merge = 0, 0, 0
        self.role, self.terms, self.of_run = None, frozenset(), {}

    def _close(self) -> Iterator[tuple]:
        if self.size >= 2:
            self.merge += 1
            yield self.merge, self.position - self.size + 1, self.position, self.role_of_run, list(self.of_run.values())[: self.keep]
        self.size, self.of_run = 0, {}

    def take(self, role, terms, noisy) -> Iterator[tuple]:
        own = {t.casefold(): t for t in reversed(terms or ()) if t is not None}
        own = {k: own[k] for k in dict.fromkeys(t.casefold() for t in terms or () if t is not None)}
        joins = not noisy and self.size > 0 and role == self.role and (self.size < self.free or not self.terms.isdisjoint(own))
        if not joins:
            yield from self._close()
        self.position += 1
        self.role, self.terms = role, frozenset(own)
        if not noisy:
            if not self.size:
                self.role_of_run = role
            self.size += 1
            self.of_run |= {k: t for k, t in own.items() if k not in self.of_run}
            if self.size >= self.most:
                yield from self._close()

    def end(self) -> Iterator[tuple]:
        yield from self._close()


def merge_groups(parts: DataFrame, group: list[str], order: str, role: str, terms: str, noisy: str, most: int = 4, free: int = 3, keep: int = 8) -> DataFrame:
    """group, merge, first, last, role, terms: runs of two to ``most`` neighbouring parts worth merging, their role and their
    first ``keep`` terms as text, each once (see ``Merges``)."""
    rows = parts.withColumn(terms, F.col(terms).cast("array<string>"))
    return fold(rows, group, [order], [role, terms, noisy], lambda: Merges(most, free, keep), "merge int, first int, last int, role string, terms array<string>")


def merge_ranges(parts: DataFrame, group: list[str], order: str, role: str, terms: str, noisy: str, most: int = 4, free: int = 3) -> DataFrame:
    """group, merge, first, last of ``merge_groups``."""
    return merge_groups(parts, group, order, role, terms, noisy, most, free).select(*group, "merge", "first", "last")


class Chapters:
    """Chapters of at most ``micro`` lessons gather until two or more hold ``target``; a larger one joins what waits if that
    stays within ``target`` or is a single chapter, and stands alone otherwise.  A course of up to ``most`` stays as it is."""

    def __init__(self, most: int, micro: int, target: int):
        self.most, self.micro, self.target = most, micro, target
        self.position, self.first, self.held = 0, 1, 0

    def take(self, lessons, chapters) -> Iterator[tuple]:
        n = max(1, lessons or 1)
        self.position += 1
        if chapters <= self.most:
            self.first = self.position + 1
            yield self.position, self.position
            return
        waiting, held = self.position - self.first, self.held + n
        small, few = n <= self.micro, waiting <= 1 or held <= self.target
        if not small and not few:
            yield self.first, self.position - 1
            self.first = self.position
        if (waiting >= 1 and held >= self.target) if small else True:
            yield self.first, self.position
            self.first, self.held = self.position + 1, 0
        else:
            self.held = held

    def end(self) -> Iterator[tuple]:
        if self.first <= self.position:
            yield self.first, self.position


def chapter_groups(chapters: DataFrame, group: list[str], order: str, lessons: str, most: int = 24, micro: int = 2, target: int = 8) -> DataFrame:
    """group, root, first, last: ranges of chapters that make the root chapters of each course (see ``Chapters``).

    A missing or zero count of lessons is 1.  Should more than ``most`` ranges be left, equal spans of ranges are joined.
    """
    counted = chapters.join(chapters.groupBy(*group).agg(F.count("*").alias("__chapters")), group)
    ranges = fold(counted, group, [order], [lessons, "__chapters"], lambda: Chapters(most, micro, target), "first int, last int")
    place, n = F.row_number().over(Window.partitionBy(*group).orderBy("first")), F.count("*").over(Window.partitionBy(*group))
    span = F.when(n <= most, 1).otherwise(F.greatest(F.lit(2), F.ceil(n / most)))
    roots = ranges.withColumn("root", (F.floor((place - 1) / span) + 1).cast("int"))
    return roots.groupBy(*group, "root").agg(F.min("first").alias("first"), F.max("last").alias("last"))
