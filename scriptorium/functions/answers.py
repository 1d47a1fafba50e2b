"""JSON out of the answers of models: documents, checks of their shape, items as texts.

Values are variants.  Keys of an object come in the order of their names; an object with a repeated key, and NaN or
Infinity, count as no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import fence_body, let, without_thoughts
from .text import WHITE, normalize_whitespace

# Keys whose lists hold items, keys of the parts of an item (of each the first that says something), levels of risk.
LISTS = ("items", "points", "facts", "claims", "arguments", "examples", "notes")
PARTS = (("time", "timestamp", "source"), ("title", "label"), ("text", "content", "summary", "claim", "fact"))
RISKS = ("low", "medium", "high")
_NOTHING = ("null", '""', "0", "0.0", "-0", "-0.0", "false", "[]", "{}")


def kind(value: Column, name: str | None = None) -> Column:
    """The kind of a value, or of a field of it, as ``schema_of_variant`` names it; empty where there is none."""
    return F.coalesce(F.schema_of_variant(field(value, name) if name else value), F.lit(""))


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def strict(text: Column) -> Column:
    """The value of a text that is JSON as a whole, else null.

    The parser stops after the first value, so the text is read as the first of two members: the other one is its hash,
    which must come right after it.
    """
    pair, mark = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]'))), F.md5(text)
    return let(pair, lambda v: F.when((kind(F.try_variant_get(v, "$[1]", "variant")) == "STRING") & (F.try_variant_get(v, "$[1]", "string") == mark) & F.try_variant_get(v, "$[2]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")))


def in_braces(text: Column) -> Column:
    """From the first opening to the last closing brace, else empty."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def parsed(plain: Column) -> Column:
    """The text as JSON, else what its braces hold; null where neither is JSON."""
    return F.coalesce(strict(plain), strict(in_braces(plain)))


def json_document(text: Column) -> Column:
    """An object whatever the text: its JSON, without a fence; what is no object as ``items``; no JSON as ``raw``."""

    def wrapped(p: Column) -> Column:
        doc = parsed(p)
        raw = F.parse_json(F.to_json(F.struct(p.alias("raw"))))
        return F.when(doc.isNull(), raw).when(kind(doc).startswith("OBJECT"), doc).otherwise(F.parse_json(F.concat(F.lit('{"items":'), F.to_json(doc), F.lit("}"))))

    return let(fence_body(text), wrapped)


def local_answer(text: Column) -> Column:
    """``cleaned``, ``json``: an answer without its thoughts, and its JSON (null where it holds none); ``cleaned`` is the part that was JSON."""

    def answer(p: Column) -> Column:
        whole, braces = strict(p), in_braces(p)
        inner = strict(braces)
        return F.struct(F.when(whole.isNull() & inner.isNotNull(), braces).otherwise(p).alias("cleaned"), F.coalesce(whole, inner).alias("json"))

    return let(without_thoughts(text), answer)


def is_decision(value: Column) -> Column:
    """An object with a boolean ``worthEmail``, ``importance`` from 1 to 5, a text as ``reason`` and a list of ``tags``."""
    number = F.when(kind(value, "importance").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$.importance", "double"))
    return (
        kind(value).startswith("OBJECT") & (kind(value, "worthEmail") == "BOOLEAN") & F.coalesce(number.between(1, 5), F.lit(False))
        & (kind(value, "reason") == "STRING") & kind(value, "tags").startswith("ARRAY")
    )


def is_quality(value: Column) -> Column:
    """An object with a boolean ``ok``, a known ``riskLevel``, lists of ``issues`` and ``missingCriticalTerms`` and a text as ``reason``."""
    risk = F.when(kind(value, "riskLevel") == "STRING", F.try_variant_get(value, "$.riskLevel", "string"))
    return (
        kind(value).startswith("OBJECT") & (kind(value, "ok") == "BOOLEAN") & F.coalesce(risk.isin(*RISKS), F.lit(False))
        & kind(value, "issues").startswith("ARRAY") & kind(value, "missingCriticalTerms").startswith("ARRAY") & (kind(value, "reason") == "STRING")
    )


def says(value: Column) -> Column:
    """Neither missing nor null, empty, zero or false."""
    return value.isNotNull() & ~F.coalesce(F.to_json(value), F.lit("null")).isin(*_NOTHING)


def plain_text(value: Column) -> Column:
    """A value as one clean text; null is empty, objects and lists are their JSON, true and false have a capital."""
    k = kind(value)
    text = F.when(k.isin("", "VOID"), "").when(k == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string"))).when(k.rlike("^(OBJECT|ARRAY)"), F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))
    return normalize_whitespace(text)


def item_text(item: Column) -> Column:
    """The parts of an object that say something, a space between them; any other value as text."""
    parts = [plain_text(F.coalesce(*(F.when(says(field(item, n)), field(item, n)) for n in names))) for names in PARTS]
    return F.when(kind(item).startswith("OBJECT"), F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")).otherwise(plain_text(item))


def items(value: Column, limit: int = 8) -> Column:
    """The first ``limit`` items of a value as texts, each once whatever its case and white space.

    Of an object the lists under known keys count, or all its values where it has no such list with anything in it; a list
    is its members; a single value is one item unless it says nothing.
    """
    none = F.array().cast("array<variant>")
    listed = lambda path: F.coalesce(F.try_variant_get(value, path, "array<variant>"), none)
    known = F.concat(*(listed(f"$.{n}") for n in LISTS))
    all_ = F.coalesce(F.map_values(F.try_variant_get(value, "$", "map<string,variant>")), none)
    found = (
        F.when(kind(value).startswith("OBJECT"), F.when(F.size(known) > 0, known).otherwise(all_))
        .when(kind(value).startswith("ARRAY"), listed("$")).when(says(value), F.array(value)).otherwise(none)
    )
    texts = F.filter(F.transform(found, item_text), lambda t: t != "")

    def first(of: Column) -> Column:
        marks = F.transform(of, lambda t: F.lower(F.regexp_replace(t, WHITE, "")))
        return let(marks, lambda ms: F.transform(F.slice(F.array_distinct(ms), 1, limit), lambda m: F.element_at(of, F.array_position(ms, m).cast("int"))))

    return let(texts, first)
