"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

A text's words are the runs of ASCII letters, digits and non-ASCII characters after A-Z have been
lower-cased. A window is ``n`` consecutive words of an item; an item of fewer words is one window.
Windows are held as tuples of word numbers under their hash, so a hit is verified by equality.

Scale. The index goes to executors as a broadcast. Its size is checked first: items are dealt into
blocks of about ``BLOCK_BYTES`` of text (a longer item is cut into overlapping parts), and with more
than one block the documents are scanned against one block after the other (a stated query set against
all rows, in blocks): a block's hits, keyed by their text's digest, are checkpointed and its broadcast
is destroyed before the next block is fetched, so driver and workers hold one block at a time. With a
single block nothing is shuffled; with several, hits are small and meet the documents in one join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from canopyframe.llm.textio import byte_slices
from canopyframe.plans.lineage import cut

WINDOW = 10
#: Bytes of item text in one broadcast index, about (an index takes some forty times its text).
BLOCK_BYTES = 4_000_000

_KEEP = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))
#: The same words in a text whose case is as written, for offsets.
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
RESULT = "struct<n_words:bigint,hits:array<struct<first:bigint,last:bigint>>,items:array<{item}>,chars:array<struct<start:bigint,end:bigint>>>"


def normal_words(text: bytes) -> list[bytes]:
    """Lower-cased ASCII letters and digits and non-ASCII characters, in runs."""
    return text.translate(_TABLE).split()


class WindowIndex:
    """Word numbers, and for each window length the windows with their items."""

    def __init__(self, items: list[tuple[object, str | None]], n: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, tuple]] = {}
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in normal_words((text or "").encode())], np.int32)
            length = min(n, len(ids))
            for i in range(len(ids) - length + 1 if length else 0):
                at = self.windows.setdefault(length, {})
                key = ids[i : i + length].tobytes()
                owners = at.get(key, ())
                if item not in owners:
                    at[key] = (*owners, item)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
        """Merged (first, last) word places inside occurrences, and the items that occur."""
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        spans, items = [], set()
        for length, windows in self.windows.items():
            for i in np.flatnonzero(known[length:] - known[:-length] == length).tolist():
                if (owners := windows.get(ids[i : i + length].tobytes())) is not None:
                    spans.append((i, i + length - 1))
                    items.update(owners)
        return merge(spans), sorted(x for x in items if x is not None)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _char_spans(text: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    places = [m.span() for m in _WORD.finditer(text.decode())]
    return [(places[a][0], places[b][1]) for a, b in hits]


def _struct(name: tuple[str, str], lists: list[list[tuple[int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([(name[0], pa.int64()), (name[1], pa.int64())]))
    return pa.array([[dict(zip(name, x)) for x in row] for row in lists], kind)


def _scan_column(text: Column, index, kind: DataType) -> Column:
    """``index`` is a Spark broadcast of a WindowIndex, ``kind`` the item ids' type."""
    of_items = pa.list_(to_arrow_type(kind))

    @F.arrow_udf(RESULT.format(item=kind.simpleString()))
    def kernel(texts: pa.Array) -> pa.Array:
        counts, hits, items, chars = [], [], [], []
        for part in byte_slices(texts):
            for x in part:
                words = normal_words(x)
                found, which = index.value.scan(words) if words else ([], [])
                counts.append(len(words))
                hits.append(found)
                items.append(which)
                chars.append(_char_spans(x, found) if found else [])
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), _struct(("first", "last"), hits), pa.array(items, of_items), _struct(("start", "end"), chars)], ["n_words", "hits", "items", "chars"])

    return kernel(text)


def item_parts(benchmark: DataFrame, id_col: str, text_col: str, most: int, n: int) -> DataFrame:
    """``(i, t)``: items; one of over ``most`` bytes as parts of its words that hold each window once."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    step = max(n, most // 8)  # words of a part
    low = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(low, F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)), F.lit(step))
    parts = F.transform(starts, lambda at: F.array_join(F.slice("w", at + 1, F.lit(step + n - 1)), " "))
    long = items.filter(F.octet_length("t") > most).select("i", words.alias("w")).select("i", F.explode(parts).alias("t"))
    return items.filter(F.coalesce(F.octet_length("t") <= most, F.lit(True))).unionByName(long)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES, n: int = WINDOW) -> tuple[int, Callable[[int], list]]:
    """Number of blocks, and how to fetch one: items by hash, each block of about half ``most`` bytes."""
    items = item_parts(benchmark, id_col, text_col, most, n)
    total = items.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    count = max(1, -(-2 * total // most)) if total > most else 1
    part = F.pmod(F.xxhash64("i", "t"), F.lit(count))
    return count, lambda k: [(r.i, r.t) for r in items.filter(part == k).collect()]


def scanned(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, n: int, block_bytes: int, columns: dict[str, Column]) -> DataFrame:
    """``columns`` of docs beside ``n_words, hits, items, chars`` of their text over all blocks."""
    count, fetch = item_blocks(benchmark, item_col, item_text, block_bytes, n)
    kind = benchmark.schema[item_col].dataType
    context = docs.sparkSession.sparkContext
    own = [c.alias(name) for name, c in columns.items()]
    text = docs.select(docs[text_col].alias("t"))
    if count == 1:
        return docs.select(*own, _scan_column(docs[text_col], context.broadcast(WindowIndex(fetch(0), n)), kind).alias("r")).select(*columns, "r.*")
    found = None
    for k in range(count):
        index = context.broadcast(WindowIndex(fetch(k), n))
        rows = text.select(F.sha2("t", 256).alias("key"), _scan_column(F.col("t"), index, kind).alias("r")).filter(F.size("r.hits") > 0)
        rows = cut(rows.select("key", F.col("r.hits").alias("hits"), F.col("r.items").alias("items"), F.col("r.chars").alias("chars")).dropDuplicates(["key"]))
        index.destroy()
        found = rows if found is None else found.unionByName(rows)
    flat = lambda name: F.flatten(F.collect_list(name))
    merged = found.groupBy("key").agg(flat("hits").alias("hits"), flat("items").alias("items"), flat("chars").alias("chars"))
    merged = merged.select("key", _merged(F.col("hits"), "first", "last", 1).alias("hits"), F.array_sort(F.array_distinct("items")).alias("items"), _merged(F.col("chars"), "start", "end", 0).alias("chars"))
    none = context.broadcast(WindowIndex([], n))
    rows = docs.select(F.struct(*own).alias("own"), F.sha2(docs[text_col], 256).alias("key"), _scan_column(docs[text_col], none, kind)["n_words"].alias("n_words"))
    rows = rows.join(merged, "key", "left")
    empty = lambda name: F.coalesce(F.col(name), F.array().cast(merged.schema[name].dataType)).alias(name)
    return rows.select(*[F.col("own")[c].alias(c) for c in columns], "n_words", empty("hits"), empty("items"), empty("chars"))


def _merged(spans: Column, first: str, last: str, touch: int) -> Column:
    """Union of sorted spans; spans at most ``touch`` apart become one."""
    kind = f"array<struct<{first}:bigint,{last}:bigint>>"

    def step(acc: Column, x: Column) -> Column:
        end = F.element_at(acc, -1)
        joined = F.struct(end[first].alias(first), F.greatest(end[last], x[last]).alias(last))
        return F.when((F.size(acc) > 0) & (x[first] <= F.try_element_at(acc, F.lit(-1))[last] + touch), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def flag_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: ``id_col, n_words, n_hit, n_items, items, spans, contaminated``.

    ``items`` are the sorted ids of items with an occurring window, ``spans`` the code-point ranges
    of hit words. A null text has no words; a null item text has no windows; an item with a null id
    makes hits but is not listed. Repeated rows stay, repeated items count once by id. Empty tables
    give an empty result, or no hits. Other columns are not looked at. Texts are scanned whole.
    """
    rows = scanned(docs, benchmark, text_col, item_col, item_text, n, block_bytes, {"id": docs[id_col]})
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return rows.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.col("chars").alias("spans"), (n_hit > 0).alias("contaminated"))


def _without(text: Column, spans: Column) -> Column:
    """``text`` less the given sorted, disjoint code-point spans."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    kept = F.aggregate(spans, begin, lambda acc, x: F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))).alias("out")))
    return F.concat(kept["out"], F.substring(text, (kept["at"] + 1).cast("int"), F.length(text)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "drop", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with its own columns, less contaminated rows (``drop``) or hit spans (``spans``)."""
    if mode not in ("drop", "spans"):
        raise ValueError("mode is 'drop' or 'spans'")
    # the document's columns ride in a struct, so that no name of theirs can clash
    row = F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns])
    rows = scanned(docs, benchmark, text_col, item_col, item_text, n, block_bytes, {"row": row})
    if mode == "drop":
        return rows.filter(F.size("hits") == 0).select("row.*")
    own = F.col("row")[text_col]
    clean = F.when(F.size("chars") > 0, _without(own, F.col("chars"))).otherwise(own)
    return rows.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def digest(items: Column) -> Column:
    """SHA-256 of the ids, sorted as strings and comma-joined."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)


def plain_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= n)),
occ AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS j FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.j, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
