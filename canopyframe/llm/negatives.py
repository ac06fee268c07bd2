"""Hard negatives by inner product, with coordinate pruning as in LEMP.

Vectors become integers (components times ``SCALE``, floored), so scores are exact. Each anchor has its
best rows of the same label as positives; for each positive it asks for the best rows of other labels
whose score lies in a band below the positive's. Both are searches for the best rows within bounds:
rows lie in buckets of like length, longest first, and a bucket whose longest row cannot reach an anchor's
bound is passed over. Each bucket has a sorted list of every coordinate of its unit vectors. If a row
reaches the bound, the angle between it and the anchor is at most some g, and its angle to a coordinate axis is
then within g of the anchor's; so each focus coordinate, those in which the anchor is largest, has a
range of feasible values, and the rows in all of these ranges are verified by their exact score. Where
no range holds less than ``PRUNES`` of a bucket, all of it is verified by one matrix product. The k-th best
score so far raises the bound from bucket to bucket.

Scale. Rows, in the order of label and length, are dealt into tiles of ``TILE`` rows, and anchors into blocks of
``BLOCK``; a task holds one tile and meets the anchors of one block batch by batch (a stated query set
against all rows, in blocks). An anchor first meets one tile, whose scores give it a bound, then the other
tiles that can hold what it looks for: for positives those of its label's run, for both those whose longest row
reaches the bound. Of a tile at most k rows a search leave the task. Unpruned work is anchors times rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.plans.lineage import cut
from canopyframe.plans.ranking import global_row_number

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in per cent of the positive's.
LOW, HIGH = 50, 95
TILE, BLOCK, BUCKET, CHUNK = 8192, 65_536, 1024, 1024
#: Focus coordinates of an anchor, and the share of a bucket below which their ranges are intersected.
FOCUS, PRUNES = 6, 0.5
#: Integer lengths below this keep every score within a long.
LONGEST = 2.0**31
#: Products of lengths up to this are exact in double precision.
EXACT = 2.0**52
LEAST = -(2**63) + 1
FEW_TILES = 1_000_000


def _matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list array; shorter ones end in zeros, all are cut to ``width``."""
    sizes = np.asarray(lists.value_lengths())
    wide = int(sizes.max(initial=0)) if width is None else width
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        own = values.reshape(len(sizes), sizes[0])[:, :wide]
        return own if own.shape[1] == wide else np.pad(own, ((0, 0), (0, wide - own.shape[1])))
    out = np.zeros((len(sizes), wide), np.int64)
    for i, (end, n) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist())):
        out[i, : min(n, wide)] = values[end - n : end][:wide]
    return out


def _lengths(whole: np.ndarray) -> np.ndarray:
    return np.sqrt((whole.astype(np.float64) ** 2).sum(1))


def _unit(whole: np.ndarray, length: np.ndarray) -> np.ndarray:
    return whole / np.where(length > 0, length, 1.0)[:, None]


def first_ranks(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group by falling score, then rising id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    begins = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(begins, np.diff(np.append(begins, len(g))))
    return order[rank < k]


class Bucket:
    """Rows of like length with a sorted list of each coordinate, made when it is first asked for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, length: np.ndarray):
        self.ids, self.labels, self.whole = ids, labels, whole
        self.real, self.unit = whole.astype(np.float64), _unit(whole, length)
        self.longest = float(length.max())
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f])
            self.lists[f] = self.unit[order, f], order
        return self.lists[f]

    def ranges(self, unit: np.ndarray, focus: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) place in the lists of the focus coordinates that is feasible."""
        rows = np.arange(len(unit))[:, None]
        reach = np.arccos(np.clip(cosine, -1, 1))[:, None]
        axis = np.arccos(np.clip(unit[rows, focus], -1, 1))
        low, high = np.cos(np.minimum(axis + reach, np.pi)) - 1e-9, np.cos(np.maximum(axis - reach, 0)) + 1e-9
        begin, end = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus).tolist():
            at = focus == f
            values = self.sorted_list(f)[0]
            begin[at], end[at] = np.searchsorted(values, low[at], "left"), np.searchsorted(values, high[at], "right")
        return begin, end

    def scores(self, whole: np.ndarray, longest: float, rows: np.ndarray | slice) -> np.ndarray:
        if longest * self.longest < EXACT:
            return (whole.astype(np.float64) @ self.real[rows].T).astype(np.int64)
        return whole @ self.whole[rows].T

    def candidates(self, whole: np.ndarray, length: np.ndarray, unit: np.ndarray, focus: np.ndarray, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(anchors, rows, scores)``: verified rows of at least the score that an anchor needs."""
        reach = length * self.longest
        cosine = np.where(need > 0, need / np.where(reach > 0, reach, 1), -1.0)
        may = np.flatnonzero((need <= 0) | ((reach > 0) & (cosine <= 1 + 1e-9)))
        some = len(self.ids) * PRUNES
        begin, end = self.ranges(unit[may], focus[may], cosine[may])
        wide = (end - begin).min(1, initial=len(self.ids)) >= some
        dense = may[wide | (need[may] <= 0)]
        if len(dense):
            score = self.scores(whole[dense], float(length[dense].max()), slice(None))
            a, r = np.nonzero(score >= need[dense, None])
            yield dense[a], r, score[a, r]
        for m in np.flatnonzero(~(wide | (need[may] <= 0))).tolist():
            i, lists = may[m], [j for j in range(focus.shape[1]) if end[m, j] - begin[m, j] < some]
            hits = np.zeros(len(self.ids), np.int8)
            for j in lists:
                hits[self.sorted_list(int(focus[i, j]))[1][begin[m, j] : end[m, j]]] += 1
            r = np.flatnonzero(hits == len(lists))
            score = self.scores(whole[i : i + 1], float(length[i]), r)[0]
            r, score = r[score >= need[i]], score[score >= need[i]]
            yield np.full(len(r), i), r, score


def search_tile(buckets: list[Bucket], ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, length: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
    """``(anchor, slot, score, id)``: per anchor and slot the first ``k`` rows with a score of ``low`` to ``high``.

    ``same`` asks for rows of the anchor's label but of another id, else for rows of other labels.
    """
    unit, (n, slots) = _unit(whole, length), low.shape
    focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
    low, top = low.copy(), high.max(1)
    best = [np.zeros(0, np.int64)] * 3
    for bucket in buckets:
        for a, r, score in bucket.candidates(whole, length, unit, focus, low.min(1)):
            equal = bucket.labels[r] == labels[a]
            fits = (equal & (bucket.ids[r] != ids[a]) if same else ~equal) & (score <= top[a])
            a, r, score = a[fits], r[fits], score[fits]
            e, slot = np.nonzero((score[:, None] >= low[a]) & (score[:, None] <= high[a]))
            found = (a[e] * slots + slot, score[e], bucket.ids[r[e]])
            best = [np.concatenate(x) for x in zip(best, found)]
            kept = first_ranks(*best, k)
            best = [x[kept] for x in best]
        full = np.flatnonzero(np.bincount(best[0], minlength=n * slots) == k)
        if len(full):
            last = np.full(n * slots, np.iinfo(np.int64).max)
            np.minimum.at(last, best[0], best[1])
            low.ravel()[full] = np.maximum(low.ravel()[full], last[full])
    return best[0] // slots, best[0] % slots, best[1], best[2]


def _search(rows: DataFrame, anchors: DataFrame, blocks: int, tiles: int, same: bool, k: int) -> DataFrame:
    """``(anchor, slot, score, id)``: what ``anchors`` find in the ``tile`` that each of their rows names."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, buckets = None, [], []

        def build() -> list[Bucket]:
            tile = pa.Table.from_batches(held).combine_chunks()
            whole = _matrix(tile["q"].chunk(0))
            length = _lengths(whole)
            order = np.argsort(-length, kind="stable")
            ids, labels = tile["id"].to_numpy()[order], tile["label"].to_numpy()[order]
            whole, length = whole[order], length[order]
            return [Bucket(ids[s : s + BUCKET], labels[s : s + BUCKET], whole[s : s + BUCKET], length[s : s + BUCKET]) for s in range(0, len(ids), BUCKET)]

        for batch in batches:
            keys = np.stack([batch.column(j).to_numpy() for j in range(3)], axis=1)  # tile, block, kind
            ends = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)) if len(keys) else []
            begin = 0
            for end in ends:
                here, part = tuple(keys[begin, :2].tolist()), batch.slice(begin, end - begin)
                if here != at:
                    at, held, buckets = here, [], []
                if keys[begin, 2] == 0:
                    held.append(part)
                else:
                    buckets = buckets or (build() if held else [])
                    for s in range(0, part.num_rows if buckets else 0, CHUNK):
                        chunk = part.slice(s, CHUNK)
                        col = dict(zip(chunk.schema.names, chunk.columns))
                        full = _matrix(col["q"])
                        whole = full if full.shape[1] == buckets[0].whole.shape[1] else _matrix(col["q"], buckets[0].whole.shape[1])
                        wide = int(np.asarray(col["low"].value_lengths()).max(initial=0))
                        low, high = _matrix(col["low"], wide).copy(), _matrix(col["high"], wide).copy()
                        # slots that an anchor does not have ask for nothing
                        none = np.arange(wide) >= np.asarray(col["low"].value_lengths())[:, None]
                        low[none], high[none] = 2**62, LEAST
                        a, slot, score, found = search_tile(buckets, col["id"].to_numpy(), col["label"].to_numpy(), whole, _lengths(full), low, high, same, k)
                        anchor = col["anchor"].to_numpy()
                        yield pa.RecordBatch.from_arrays([pa.array(anchor[a]), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(found)], ["anchor", "slot", "score", "id"])
                begin = end

    none = F.array().cast("array<bigint>")
    block = F.pmod("anchor", F.lit(blocks)).cast("int")
    targets = rows.select("tile", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "anchor", "id", "label", "q", none.alias("low"), none.alias("high"))
    asked = anchors.select("tile", block.alias("block"), F.lit(1).alias("kind"), "anchor", "id", "label", "q", "low", "high")
    dealt = targets.unionByName(asked).repartition(max(1, tiles * blocks), "tile", "block").sortWithinPartitions("tile", "block", "kind")
    return dealt.mapInArrow(kernel, "anchor long, slot int, score long, id long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor's slot, with their ``rank``."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _bounds(found: DataFrame, k: int) -> DataFrame:
    """``(anchor, bounds)``: the k-th best score of each slot that has found ``k`` rows, by slot."""
    full = found.groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
    return full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("bounds"))


def _raised(anchors: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``anchors`` whose lower bounds are raised to what they have found."""
    rows = anchors.join(_bounds(found, k), "anchor", "left")
    raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("bounds", i), F.lit(LEAST))))
    return rows.withColumn("low", raised).drop("bounds")


def _reaching(anchors: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows of anchors and tiles whose longest row can reach an anchor's least bound."""
    met = anchors.join(stats, "tile")
    return met.filter(F.array_min("low").cast("double") <= F.col("length") * F.col("longest") * (1 + 1e-9)).drop("longest")


def mine_hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows that are an ``anchor``.

    Ids and labels are whole numbers; scores are integer inner products, ties go to the smaller id. Rows
    with a null id, label or vector, a null or non-finite component or an integer length of 2^31 or more (whose
    scores may not fit a long) take no part. Vectors of unlike length count as if the shorter ended in zeros. An
    anchor's positives have another id; repeated rows count each, as anchors too. A positive with a negative
    score has no negatives, since its band is empty. An empty table gives an empty result. Other columns
    are not looked at.
    """
    label = F.col(label) if isinstance(label, str) else label
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"), sound.alias("sound"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND sound").drop("sound")
    rows = rows.withColumn("q", F.transform("v", lambda x: F.floor(x.cast("double") * scale))).drop("v")
    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = rows.withColumn("length", length).filter(F.col("length") < LONGEST).withColumn("place", F.monotonically_increasing_id())
    rows = global_row_number(rows, [F.col("label"), F.desc("length"), F.col("id"), F.col("place")], name="anchor").drop("place")
    rows = cut(rows.withColumn("tile", F.expr(f"cast((anchor - 1) div {tile} as int)")))

    runs = rows.groupBy("label").agg(F.min("tile").alias("from"), F.max("tile").alias("to"))
    asks = cut(rows.filter("asks").drop("asks").join(runs, "label"))
    last, n_asks = rows.agg(F.coalesce(F.max("tile"), F.lit(0)), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0))).first()
    tiles, blocks = last + 1, max(1, -(-n_asks // block))
    stats = rows.groupBy("tile").agg(F.max("length").alias("longest"))
    stats = F.broadcast(stats) if tiles <= FEW_TILES else stats

    def both(asked: DataFrame, first: Column, others: Column, same: bool, k: int) -> DataFrame:
        """The best of ``first``, a tile whose scores give bounds, and of ``others``."""
        near = cut(_search(rows, asked.withColumn("tile", first), blocks, tiles, same, k))
        rest = _raised(asked, near, k).withColumn("tile", F.explode(F.filter(others, lambda t: t != first)))
        far = _search(rows, _reaching(rest, stats), blocks, tiles, same, k)
        return cut(_best(near.unionByName(far), k))

    start = asks.withColumn("low", F.array(F.lit(0).cast("long"))).withColumn("high", F.array(F.lit(2**63 - 1)))
    found = both(start, F.col("tile"), F.sequence("from", "to"), True, positives)

    part = lambda share, up: share * F.expr("score div 100") + F.expr(f"({share} * (score % 100) + {99 if up else 0}) div 100")
    wanted = found.withColumn("low", part(low, True)).withColumn("high", part(high, False)).filter("low <= high")
    bands = wanted.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "low", "high"))).alias("p"))
    bands = cut(asks.join(bands, "anchor").withColumn("low", F.col("p.low")).withColumn("high", F.col("p.high")))
    # tiles within an anchor's run of labels hold its label alone
    elsewhere = F.filter(F.sequence(F.lit(0), F.lit(last)), lambda t: ~((t > F.col("from")) & (t < F.col("to"))))
    after = F.when(F.col("to") < last, F.col("to") + 1).otherwise(F.greatest(F.col("from") - 1, F.lit(0)))
    mined = both(bands.drop("p"), after, elsewhere, False, negatives)
    out = mined.join(bands.select("anchor", F.col("id").alias("anchor_id"), "p"), "anchor").withColumn("p", F.element_at("p", F.col("slot") + 1))
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same, CAST(list_dot_product(a.q, e.q) AS BIGINT) AS score
      FROM e AS a JOIN e ON a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE same AND vec_id <> anchor_id) WHERE k <= 5),
n AS (SELECT p.r, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
      row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
