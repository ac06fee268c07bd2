"""Match positions with built-in functions only.

A span is ``struct<start, kind, end>`` (code points, end exclusive, kind a number), so that the
natural order of an array of spans is by start, then kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,kind:int,end:int>>"
FOUND = "array<struct<start:int,end:int,m:string>>"
#: Matches that are added up at a time: an array grows by copying, which costs the square of its length.
BLOCK = 128
#: Code points of a text's pieces from which short substrings are taken.
CHUNK = 256


def matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start, end, m>>``.

    Matches come from regexp_extract_all and the text between them from split by the same pattern;
    lengths of both, added up block by block, are the places. ``gate`` is a cheap test that no match can fail.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    none_yet = F.array().cast(FOUND).alias("out")

    def step(acc: Column, x: Column) -> Column:
        start = (acc["at"] + F.length(x["b"])).cast("int")
        end = (start + F.length(x["m"])).cast("int")
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("out"))

    def add_block(acc: Column, block: Column) -> Column:
        at = F.coalesce(F.try_element_at(acc, F.lit(-1))["at"], F.lit(0))
        return F.concat(acc, F.array(F.aggregate(block, F.struct(at.alias("at"), none_yet), step)))

    def places(p: Column) -> Column:
        last = F.floor((F.size(p) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(p, i * BLOCK + 1, F.lit(BLOCK)))
        return F.aggregate(blocks, F.array().cast(f"array<struct<at:int,out:{FOUND}>>"), add_block, lambda acc: F.flatten(F.transform(acc, lambda x: x["out"])))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    # the array of one binds the pairs to a name, so that they are found once
    out = F.transform(F.array(pairs), places)[0]
    none = F.array().cast(FOUND)
    return out if gate is None else F.when(gate, out).otherwise(none)


def as_spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, though ``use`` names it inside of lambdas."""
    return F.transform(F.array(value), use)[0]


def blocked(spans: Column) -> Column:
    """Sorted spans in blocks, each with its least start and greatest end, for ``overlaps``."""
    last = F.floor((F.size(spans) - 1) / BLOCK).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(spans, i * BLOCK + 1, F.lit(BLOCK)))
    return F.transform(parts, lambda p: F.struct(F.array_min(F.transform(p, lambda s: s["start"])).alias("low"), F.array_max(F.transform(p, lambda s: s["end"])).alias("high"), p.alias("part")))


def overlaps(blocks: Column, start: Column, end: Column) -> Column:
    """Whether a span of ``blocked`` spans shares a place with the given range."""
    return F.exists(blocks, lambda b: (b["low"] < end) & (b["high"] > start) & F.exists(b["part"], lambda s: (s["start"] < end) & (s["end"] > start)))


def chunks(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points: a substring of the whole is found by walking all before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(parts: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of a text in ``chunks``."""
    first = F.floor(start / CHUNK).cast("int")
    many = F.floor((F.greatest(end, start + 1) - 1) / CHUNK).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(parts, first + 1, many), ""), (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.lit(kinds)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def replaced(text: Column, spans: Column, marks: list[str]) -> Column:
    """``text`` with each sorted span replaced by its kind's mark; overlapping spans become one."""
    names = F.lit(marks)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def marked(parts: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            grown = F.when(x["start"] >= acc["at"], F.concat(acc["out"], piece(parts, acc["at"], x["start"]), F.element_at(names, x["kind"] + 1))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], x["end"]).cast("int").alias("at"), grown.alias("out"))

        return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], piece(parts, acc["at"], F.length(text))))

    return F.when(F.size(spans) > 0, bound(chunks(text), marked)).otherwise(text)
