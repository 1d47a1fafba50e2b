"""Every registered query: a Spark program and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from . import answers, chunks, courses, indexes, inventory, lessons, listings, packages, records, relational, scheduling, streams, texts, tracks
from .query import Query

QUERIES: dict[str, Query] = {**texts.QUERIES, **relational.QUERIES, **scheduling.QUERIES, **packages.QUERIES, **inventory.QUERIES, **courses.QUERIES, **tracks.QUERIES, **records.QUERIES, **chunks.QUERIES, **lessons.QUERIES, **streams.QUERIES, **indexes.QUERIES, **answers.QUERIES, **listings.QUERIES}
