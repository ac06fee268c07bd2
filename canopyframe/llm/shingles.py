"""Links between texts whose five-word shingles have a Jaccard similarity of ``LEAST`` or more.

Such pairs differ in three to some fifteen of SimHash's 64 bits, and a covering family for fifteen bits
has 65,535 tables, so the near-deduplication stage finds them by minwise bands beside its fingerprints:
two texts meet if the ``ROWS`` minima of one of ``BANDS`` bands agree, which pairs at a similarity of
0.8 miss with a probability below 1e-4. Every link is confirmed on the whole sets of shingles.

Scale. Only bands that several texts share go on. What is looked for is which groups hang together, so
a pair is compared only if its ends are not yet in one group. First each bucket's best connected text is
compared with its other members (in small buckets all of the first ``SMALL`` are), which settles groups
of copies, however large, by a pair a member. Then the members of a bucket that are in different groups
meet in one task, which holds at most ``BUCKET`` texts and ``BULK`` shingles: sketches, a byte of each
minimum, say which pairs are worth a look (``ALIKE`` equal bytes, four deviations below the least
similarity), their sets decide, and a link joins their groups there and then, so at most one link a
member leaves the task. A larger bucket is cut into blocks of half that size, by falling number of shingles, and each
pair of blocks whose sizes let a link be is such a task, in one pass: as many tasks as the square of the
blocks, each within the same bounds. Sets are built of texts with a pair to compare only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.llm.bitmaps import marked
from canopyframe.llm.textio import byte_slices, space_words
from canopyframe.operators.graph import connected_components
from canopyframe.plans.lineage import cut
from canopyframe.plans.ranking import running_sums

SHINGLE = 5
LEAST = 0.8
ROWS, BANDS = 7, 40
SMALL = 16
BUCKET = 4096
BULK = 4_000_000
ALIKE = 196  # of ROWS * BANDS
BLOCK = 2048


def text_key(text: Column) -> Column:
    """Digest of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def shingle_hashes(text: bytes) -> np.ndarray:
    """Distinct hashes of a text's shingles; fewer words are one shingle, no words none."""
    words = space_words(text.lower())
    many = len(words) - SHINGLE + 1 if len(words) > SHINGLE else min(1, len(words))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE])) for i in range(many)), np.uint64, many))


@cache
def _family() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd factors and summands of the hash functions, and odd factors that join a band's minima."""
    draw = np.random.default_rng(5)
    n = ROWS * BANDS
    odd = lambda k: draw.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(n), draw.integers(0, 2**63, n, dtype=np.uint64), odd(ROWS)


def minima(hashes: np.ndarray) -> np.ndarray:
    factor, summand, _ = _family()
    low = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        mixed = hashes[at : at + BLOCK, None] * factor + summand
        low = np.minimum(low, (mixed ^ (mixed >> np.uint64(32))).min(0))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    return ((low.reshape(BANDS, ROWS) * _family()[2]).sum(1, dtype=np.uint64) * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def keys_column(text: Column) -> Column:
    """``struct<keys, size>``: band keys and number of shingles; a text without words has no keys."""

    @F.arrow_udf("struct<keys:array<bigint>,size:int>")
    def kernel(texts: pa.Array) -> pa.Array:
        found = [shingle_hashes(x) for part in byte_slices(texts) for x in part]
        keys = [band_keys(minima(h)) if len(h) else np.zeros(0, np.int64) for h in found]
        return pa.StructArray.from_arrays([pa.array(keys, pa.list_(pa.int64())), pa.array([len(h) for h in found], pa.int32())], ["keys", "size"])

    return kernel(text)


def sketch_column(text: Column) -> Column:
    """``struct<sketch, hashes>``: a byte of each minimum, and the sorted shingle hashes, as bytes."""

    @F.arrow_udf("struct<sketch:binary,hashes:binary>")
    def kernel(texts: pa.Array) -> pa.Array:
        found = [shingle_hashes(x) for part in byte_slices(texts) for x in part]
        # of the multiplied minima, since their own top bytes are near zero
        sketches = [(minima(h) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes() for h in found]
        return pa.StructArray.from_arrays([pa.array(sketches, pa.binary()), pa.array([h.tobytes() for h in found], pa.binary())], ["sketch", "hashes"])

    return kernel(text)


def shingles_column(text: Column) -> Column:
    @F.arrow_udf("array<bigint>")
    def kernel(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_hashes(x).view(np.int64) for part in byte_slices(texts) for x in part], pa.list_(pa.int64()))

    return kernel(text)


def bucket_links(group: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of groups that links between a bucket's texts join: a forest, so fewer than texts.

    Texts of sides 1 and 2 are compared across only, those of side 0 with all.
    """
    label, links = group.copy(), []
    size = np.array([len(x) for x in sets])
    for i in range(len(sets) - 1):
        other = np.flatnonzero((label[i + 1 :] != label[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 0))) + i + 1
        other = other[np.minimum(size[other], size[i]) >= LEAST * np.maximum(size[other], size[i])]
        other = other[(sketch[other] == sketch[i]).sum(1) >= ALIKE]
        for j in other.tolist():
            if label[j] != label[i]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= LEAST * (size[i] + size[j] - common):
                    links.append((int(group[i]), int(group[j])))
                    label[label == label[j]] = label[i]
    return links


def _link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of groups within buckets; rows ``key, c, side, sketch, hashes`` come sorted by key. Holds one bucket."""
    kinds = pa.schema({"key": pa.int64(), "c": pa.int64(), "side": pa.int32(), "sketch": pa.binary(), "hashes": pa.binary()})
    held = kinds.empty_table()

    def settle(rows: pa.Table) -> pa.RecordBatch:
        key, group, side = (rows[c].to_numpy() for c in ("key", "c", "side"))
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(key), ROWS * BANDS)
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1 if len(key) else np.zeros(0, np.int64)
        links = []
        for s, e in zip([0, *ends[:-1].tolist()], ends.tolist()):
            sets = [np.frombuffer(x, np.uint64) for x in rows["hashes"].slice(s, e - s).to_pylist()]
            links += bucket_links(group[s:e], sketch[s:e], sets, side[s:e])
        a, b = zip(*links) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["ca", "cb"])

    for batch in batches:
        held = pa.concat_tables([held, pa.Table.from_batches([batch]).select(kinds.names).cast(kinds)])
        key = held["key"].to_numpy()
        done = int(np.flatnonzero(key == key[-1])[0]) if len(key) else 0  # the last bucket may go on
        if done:
            yield settle(held.slice(0, done))
            held = held.slice(done)
    yield settle(held)


def in_block_pairs(rows: DataFrame, bucket: int) -> DataFrame:
    """``key, sid, c, side``: members of buckets (``key, sid, c, size``) in each pair of their bucket's blocks.

    A block holds at most half of ``bucket`` texts and half of ``BULK`` shingles, and one text more. The new key
    names the pair. Of two blocks, the larger sizes come first, a pair whose sizes are too far apart is left out.
    """
    part = F.greatest(F.lit(2.0 / bucket), F.col("size") * (2.0 / BULK))
    run = running_sums(rows, [F.desc("size"), F.col("sid")], ["key"], {"upto": part})
    placed = cut(run.select("key", "sid", "c", "size", F.ceil("upto").cast("int").alias("block")))
    blocks = placed.groupBy("key", "block").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    larger = blocks.select("key", F.col("block").alias("i"), F.col("least").alias("from"))
    pairs = larger.join(blocks.select("key", F.col("block").alias("j"), "most"), "key").filter("i <= j").filter(F.col("most") >= LEAST * F.col("from"))
    ends = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("i").alias("block"), F.lit(1).alias("side")), F.struct(F.col("j").alias("block"), F.lit(2).alias("side"))))
    dealt = pairs.select("key", F.xxhash64("key", "i", "j").alias("pair"), F.inline(ends))
    return placed.join(dealt, ["key", "block"]).select(F.col("pair").alias("key"), "sid", "c", "side")


def linked_groups(texts: DataFrame, groups: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(c, group)``: names of ``groups`` that links of similar texts join, and the name they share.

    ``texts`` has ``sid, text`` (text keys, repeats included) and ``groups`` has ``sid, c``: what is
    already known to hang together. Groups that no link joins to another are not listed.
    """
    keys = texts.select("sid", keys_column(F.col("text")).alias("k")).groupBy("sid").agg(F.any_value("k").alias("k"))
    rows = cut(keys).select("sid", F.explode("k.keys").alias("key"), F.col("k.size").alias("size"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bulk")).filter("n > 1")
    rows = cut(rows.join(shared, "key"))
    rows = cut(rows.join(rows.groupBy("sid").agg(F.sum("n").alias("weight")), "sid").join(groups, "sid"))
    edges = None

    def current(df: DataFrame) -> DataFrame:
        """``df`` with its groups as the links so far join them, less buckets that lie in one group."""
        if edges is not None:
            joined = connected_components(edges, "ca", "cb").withColumnsRenamed({"node": "c", "component": "g"})
            df = df.join(joined, "c", "left").withColumn("c", F.coalesce("g", "c")).drop("g")
        open_ = df.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
        return cut(df.join(open_, "key", "left_semi"))

    def texts_of(sids: DataFrame) -> DataFrame:
        """A text for each of the distinct ``sid``; of the other texts few are shuffled."""
        met, may = marked(texts, "sid", cut(sids.select(F.col("sid").alias("digest"))))
        return met.filter(may).groupBy("sid").agg(F.any_value("text").alias("text")).join(sids, "sid", "left_semi")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "ca", "cb").dropDuplicates(["a", "b"]))
        ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        sets = cut(texts_of(ends).select("sid", shingles_column(F.col("text")).alias("s")))
        both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("sid").alias("b"), F.col("s").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return cut(both.filter(common >= LEAST * (F.size("sa") + F.size("sb") - common)).select("ca", "cb"))

    def with_pivots(df: DataFrame, pivots: DataFrame) -> DataFrame:
        other = pivots.select("key", F.col("sid").alias("a"), F.col("c").alias("ca"))
        return df.select("key", F.col("sid").alias("b"), F.col("c").alias("cb")).join(other, "key").filter("ca <> cb")

    def add(found: DataFrame) -> None:
        nonlocal edges
        edges = found if edges is None else edges.unionByName(found)

    first = Window.partitionBy("key").orderBy(F.desc("weight"), "sid")
    rows = current(rows)
    ranked = rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= SMALL)
    add(confirmed(with_pivots(rows, ranked.filter(f"rank = 1 OR n <= {SMALL}"))))

    rows = current(rows.filter(F.col("n") > SMALL))
    fits = (F.col("n") <= bucket) & (F.col("bulk") <= BULK)
    members = cut(rows.filter(fits).select("key", "sid", "c", F.lit(0).alias("side")).unionByName(in_block_pairs(rows.filter(~fits), bucket)))
    known = texts_of(members.select("sid").distinct()).select("sid", sketch_column(F.col("text")).alias("s")).select("sid", "s.*")
    dealt = members.join(known, "sid").drop("sid").repartition("key").sortWithinPartitions("key")
    add(cut(dealt.mapInArrow(_link_buckets, "ca long, cb long").distinct()))
    return connected_components(edges, "ca", "cb").select(F.col("node").alias("c"), F.col("component").alias("group"))
