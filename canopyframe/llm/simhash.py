"""SimHash near-duplicates found by covering locality-sensitive hashing.

Bit i of a fingerprint gets the vector m(i) in {1..31} (five bits); table v in {1..31} keeps the bits
whose inner product <m(i), v> is odd. Up to four differing bits span a space of dimension four at
most, so some v is orthogonal to all of them and the pair agrees on every bit that table v keeps:
each pair within radius 4 meets in some table, with no luck involved.

Scale. Exact copies share a fingerprint, so only distinct fingerprints enter the tables: 31 rows of
17 bytes each. Buckets stream through sorted partitions; a bucket is linked by breadth-first search
that emits a spanning forest, never its pairs. A bucket of over ``BUCKET`` fingerprints is passed
on, row by row and without being held, to an exact second way: every fingerprint emits the 2,081
values within two bits of it, and two fingerprints are within four bits if and only if they share
such a midpoint. A midpoint has at most 2,081 fingerprints, so that grouping is bounded too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.shingles import linked_groups, text_key
from canopyframe.llm.textio import byte_slices, space_words
from canopyframe.operators.graph import connected_components
from canopyframe.plans.lineage import cut

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints of a bucket that are compared with each other; above it the midpoint way costs less.
BUCKET = 4096
#: Tasks over which the fingerprints of one component are dealt when they learn their smallest id.
SALTS = 16
#: Shingles whose bits are counted at a time.
BLOCK = 8192


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of one UTF-8 text; 0 for a text without words."""
    words = space_words(text.lower())  # bytes.lower() touches A-Z only
    if not words:
        return 0
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= 1:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    stops = ends[shingle - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts[at : min(at + BLOCK, n)], stops[at : at + BLOCK])), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """Fingerprint as a (signed) long column; a null text counts as one without words."""

    @F.arrow_udf("long")
    def kernel(texts: pa.Array) -> pa.Array:
        out = [simhash(x, shingle, seed) for part in byte_slices(texts) for x in part]
        return pa.array(np.array(out, np.uint64).view(np.int64))

    return kernel(text)


def covering_masks(bits: int = 64, radius: int = RADIUS) -> list[int]:
    """The bit masks, as signed longs; any two values at most ``radius`` bits apart agree under one."""
    top = (1 << (radius + 1)) - 1
    owner = [i % top + 1 for i in range(bits)]
    masks = (sum(1 << i for i in range(bits) if (owner[i] & v).bit_count() % 2) for v in range(1, top + 1))
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct uint64 values."""
    left, edges = values, []
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= radius
            if near.any():
                found, left = left[near], left[~near]
                edges += [(root, x) for x in found]
                frontier += list(found)
    return edges


def _link_buckets(radius: int, most: int):
    """Streams rows sorted by (bucket table, key); a bucket never has to fit in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(edges: list, passed: list) -> pa.RecordBatch:
            pairs = np.concatenate(edges) if edges else np.zeros((0, 2), np.uint64)
            spill = np.concatenate(passed) if passed else np.zeros(0, np.uint64)
            both = np.concatenate([pairs, np.stack([spill, spill], axis=1)]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.arange(len(both)) >= len(pairs))], ["a", "b", "passed"])

        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        over = None  # the key of a bucket that has been passed on and still runs

        def settle(tables, keys, values, last: bool):
            nonlocal held, over
            edges, passed = [], []
            if over is not None:
                same = np.flatnonzero((tables != over[0]) | (keys != over[1]))
                cut_at = int(same[0]) if len(same) else len(keys)
                passed.append(values[:cut_at])
                tables, keys, values = tables[cut_at:], keys[cut_at:], values[cut_at:]
                over = None if len(same) else over
            new = np.flatnonzero(np.concatenate([[True], (tables[1:] != tables[:-1]) | (keys[1:] != keys[:-1])])) if len(keys) else np.zeros(0, np.int64)
            ends = np.concatenate([new[1:], [len(keys)]]).astype(np.int64) if len(new) else new
            if len(new) and not last:
                s = int(new[-1])
                if len(keys) - s > most:
                    over = (tables[s], keys[s])
                    passed.append(values[s:])
                    s = len(keys)
                held = [tables[s:], keys[s:], values[s:]]
                new, ends = new[:-1], ends[:-1]
            else:
                held = [tables[:0], keys[:0], values[:0]]
            size = ends - new
            two = new[size == 2]
            x, y = values[two], values[two + 1]
            near = np.bitwise_count(x ^ y) <= radius
            edges.append(np.stack([x[near], y[near]], axis=1))
            for s, e in zip(new[size > 2].tolist(), ends[size > 2].tolist()):
                if e - s > most:
                    passed.append(values[s:e])
                elif found := _forest(values[s:e], radius):
                    edges.append(np.array(found, np.uint64))
            return batch(edges, passed)

        for b in batches:
            got = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            yield settle(np.concatenate([held[0], got[0]]), np.concatenate([held[1], got[1]]), np.concatenate([held[2], got[2].astype(np.int64).view(np.uint64)]), False)
        yield settle(*held, True)

    return run


def _midpoint_edges(values: DataFrame) -> DataFrame:
    """Exact links among ``fp`` values for radius 4, by shared values at two bits or fewer."""
    flips = sorted({(0 if i < 0 else 1 << i) ^ (0 if j < 0 else 1 << j) for i in range(-1, 64) for j in range(-1, 64)})
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in flips]
    near = values.select("fp", F.explode(F.lit(signed)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    met = near.groupBy("mid").agg(F.array_sort(F.collect_set("fp")).alias("fps")).filter(F.size("fps") > 1)
    return met.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, len(flips))).alias("b"))


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the distinct ``fp`` values chained by links of ``radius`` bits.

    The midpoint way for large buckets is built for radius 4, and so any other radius is refused.
    """
    if radius != RADIUS:
        raise ValueError("link_fingerprints is built for a radius of 4 bits")
    masks = covering_masks(64, radius)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("mask", "key"))
    dealt = keyed.select(F.col("mask").cast("long").alias("mask"), "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key")
    found = cut(dealt.mapInArrow(_link_buckets(radius, bucket), "a long, b long, passed boolean").distinct())
    edges = found.filter("NOT passed").select("a", "b")
    large = found.filter("passed").select(F.col("a").alias("fp"))
    if large.limit(1).count():
        edges = edges.union(_midpoint_edges(large))
    return edges


def near_duplicate_components(fingerprints: DataFrame, id_col: str = "doc_id", fp_col: str = "fp") -> DataFrame:
    """``(fp, component, component_id)``: the component's name and the smallest id that its links reach."""
    fps = fingerprints.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least"))
    links = connected_components(link_fingerprints(fps.select("fp")))
    named = fps.join(links.withColumnRenamed("node", "fp"), "fp", "left")
    linked = named.filter("component IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    # a component with very many fingerprints is dealt over SALTS tasks
    ids = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    alone = named.filter("component IS NULL").select("fp", F.col("fp").alias("component"), F.col("least").alias("component_id"))
    return alone.unionByName(linked.join(ids, ["component", "salt"]).select("fp", "component", "component_id"))


def simhash_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Nulls and texts without words have fingerprint zero and link like any other. Rows with a null id
    keep their row and count in no minimum (their component_id is null if no member has an id).
    Repeated rows stay. Columns other than id and text are not looked at, whatever their names. An
    empty table gives an empty result. Very long texts are hashed whole, a block of shingles at a time.
    """
    hashed = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")))
    parts = near_duplicate_components(hashed)
    return hashed.join(parts, "fp").select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of its smallest id (any one, if none has an id).

    A group hangs together by fingerprints within four bits and by pairs whose five-word shingles have a
    Jaccard similarity of 0.8 or more (``shingles``). All columns stay. The choice is made on ids and
    digests; texts pass one join by id, and those with a similar text another. Ids that stand in several
    rows are told apart by their texts, and exact repeats leave one row. Texts without words
    link like any other. An empty table gives an empty result.
    """
    text = F.col(text_col)
    slim = cut(docs.select(F.col(id_col).alias("id"), text_key(text).alias("sid"), fingerprint_column(text).alias("fp")))
    groups = cut(slim.select("sid", "fp").distinct().join(near_duplicate_components(slim, "id"), "fp").select("sid", F.col("component").alias("c")))
    texts = docs.select(text_key(text).alias("sid"), text.alias("text")).filter(F.col("text").isNotNull())
    joined = linked_groups(texts, groups)
    groups = groups.join(joined, "c", "left").select("sid", F.coalesce("group", "c").alias("c"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sid"))
    best = slim.join(groups, "sid").groupBy("c").agg(first.alias("m")).select(F.col("m.id").alias("id"), F.col("m.sid").alias("sid"))
    times = slim.groupBy(F.col("id").alias("times_id")).agg(F.count("*").alias("times"))
    best = cut(best.join(times, F.col("id").eqNullSafe(F.col("times_id"))).drop("times_id"))
    # the document's columns ride in a struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = F.col("row")[id_col].eqNullSafe(F.col("id"))
    kept = rows.join(best.filter("times = 1"), own, "left_semi")
    several = rows.join(best.filter("times > 1"), own).filter(text_key(F.col("row")[text_col]) == F.col("sid"))
    return kept.unionByName(several.dropDuplicates(["id", "sid"]).select("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
