"""Spatial joins as equi-joins on grid cells with a residual.

A range condition alone would be planned as a nested loop. Rows of one side are sent to every cell
they can meet, the other side to its own cell, and the exact test follows the equality of cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from canopyframe.plans.lineage import saved


def cell(c: str | Column, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size)


def shifted(radius: int) -> Column:
    """Exploded (dx, dy) of a square neighbourhood."""
    r = range(-radius, radius + 1)
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in r for b in r]))


def near_pairs(df: DataFrame, group: list[str], x: str, y: str, key: str, distance: float, keep: list[str], *, strict: bool = True) -> DataFrame:
    """Pairs of rows of one group closer than ``distance`` on both axes, each pair once (key_a < key_b).

    Columns in ``keep`` come out with suffixes _a and _b.
    """
    cols = [key, x, y, *keep]
    base = df.select(*group, F.struct(*cols).alias("v"), cell(x, distance).alias("cx"), cell(y, distance).alias("cy"))
    a = base.select(*group, F.col("v").alias("a"), "cx", "cy", shifted(1).alias("s")).select(*group, "a", (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"))
    dx, dy = F.abs(F.col(f"a.{x}") - F.col(f"v.{x}")), F.abs(F.col(f"a.{y}") - F.col(f"v.{y}"))
    close = (dx < distance) & (dy < distance) if strict else (dx <= distance) & (dy <= distance)
    rows = a.join(base, [*group, "cx", "cy"]).filter(F.col(f"a.{key}") < F.col(f"v.{key}")).filter(close)
    return rows.select(*group, *[F.col(f"a.{c}").alias(f"{c}_a") for c in cols], *[F.col(f"v.{c}").alias(f"{c}_b") for c in cols])


def overlapping_rectangles(a: DataFrame, b: DataFrame, group: list[str], size: float) -> DataFrame:
    """Rows (struct a, struct b) whose rectangles (minx..maxy) share positive area.

    Rectangles are sent to all cells of side ``size`` they touch; a pair counts only in the cell of its
    intersection's lower corner.
    """
    span = lambda lo, hi: F.explode(F.sequence(cell(lo, size), cell(hi, size)))

    def placed(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in group]
        rows = df.select(*group, F.struct(*rest).alias(name), span("minx", "maxx").alias("cx"), "miny", "maxy")
        return rows.select(*group, name, "cx", span("miny", "maxy").alias("cy"))

    low = lambda c: F.greatest(f"a.{c}", f"b.{c}")
    high = lambda c: F.least(f"a.{c}", f"b.{c}")
    area = (high("maxx") > low("minx")) & (high("maxy") > low("miny"))
    home = (cell(low("minx"), size) == F.col("cx")) & (cell(low("miny"), size) == F.col("cy"))
    return placed(a, "a").join(placed(b, "b"), [*group, "cx", "cy"]).filter(home & area).select(*group, "a", "b")


def visible_boxes(tiles: DataFrame, instances: DataFrame, group: list[str], size: float, tile: str = "tile") -> DataFrame:
    """``tile, id``, the box clipped to the tile, and its ``visible`` area and ``share``: what no union of higher boxes covers.

    Of two boxes the one with the greater ``z`` lies above, at ties the one with the greater id. Boxes of which
    nothing is visible in a tile are left out. The union is summed over strips between successive x of the
    covering boxes: a strip's covered height is the length of the union of their y ranges, by a running
    maximum. Work grows with the square of the boxes that cover one, which strips and tiles keep apart.
    """
    met = overlapping_rectangles(tiles, instances, group, size)
    low, high = (lambda c: F.greatest(f"a.{c}", f"b.{c}").alias(c)), (lambda c: F.least(f"a.{c}", f"b.{c}").alias(c))
    inner = [low("minx"), high("maxx"), low("miny"), high("maxy")]
    clipped = met.select(F.col(f"a.{tile}").alias(tile), F.col("b.id").alias("id"), F.col("b.z").alias("z"), *inner)
    above = F.struct("b.z", "b.id") > F.struct("a.z", "a.id")
    cover = overlapping_rectangles(clipped, clipped, [tile], size / 4).filter(above).select(tile, F.col("a.id").alias("id"), *inner)
    key = [tile, "id"]
    cuts = cover.select(*key, F.explode(F.array("minx", "maxx")).alias("x")).distinct()
    strips = cuts.withColumn("x2", F.lead("x").over(Window.partitionBy(*key).orderBy("x"))).filter("x2 IS NOT NULL")
    spanned = cover.join(strips, key).filter("minx <= x AND maxx >= x2")
    before = F.max("maxy").over(Window.partitionBy(*key, "x").orderBy("miny", "maxy").rowsBetween(Window.unboundedPreceding, -1))
    more = F.greatest(F.col("maxy") - F.greatest("miny", F.coalesce("before", "miny")), F.lit(0))
    hidden = spanned.withColumn("before", before).groupBy(*key).agg(F.sum(more * (F.col("x2") - F.col("x"))).alias("hidden"))
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    rows = clipped.join(hidden, key, "left").withColumn("visible", area - F.coalesce("hidden", F.lit(0)))
    return rows.filter("visible > 0").select(*key, "minx", "maxx", "miny", "maxy", "visible", (F.col("visible") / area).alias("share"))


def within_grid(df: DataFrame, anchors: DataFrame, group: list[str], x: str, y: str, radius: int) -> DataFrame:
    """Rows of ``df`` within Chebyshev ``radius`` of an anchor on an integer grid: a semi-join on exploded cells."""
    cells = anchors.select(*group, F.col(x).alias("ax"), F.col(y).alias("ay")).distinct()
    ring = cells.select(*group, "ax", "ay", shifted(radius).alias("s")).select(*group, (F.col("ax") + F.col("s.dx")).alias(x), (F.col("ay") + F.col("s.dy")).alias(y)).distinct()
    return df.join(ring, [*group, x, y], "left_semi")


def neighbour_counts(df: DataFrame, group: list[str], x: str, y: str, step: int, flag: Column) -> DataFrame:
    """``df`` with the number of flagged rows in the 8 surrounding grid places."""
    base = df.withColumn("__x", cell(x, step)).withColumn("__y", cell(y, step))
    marks = base.filter(flag).groupBy(*group, "__x", "__y").agg(F.count("*").alias("__n"))
    ring = marks.select(*group, "__x", "__y", "__n", shifted(1).alias("s")).filter("s.dx <> 0 OR s.dy <> 0")
    near = ring.groupBy(*group, (F.col("__x") + F.col("s.dx")).alias("__x"), (F.col("__y") + F.col("s.dy")).alias("__y")).agg(F.sum("__n").alias("near"))
    return base.join(near, [*group, "__x", "__y"], "left").withColumn("near", F.coalesce("near", F.lit(0).cast("long"))).drop("__x", "__y")


def cell_sides(targets: DataFrame, group: list[str], dims: list[str], want: float) -> DataFrame:
    """``(*group, side, n)``: for each group its targets, and a side of cells that hold about ``want`` of them.

    It follows from the group's extent and count, and is halved for the groups in which a cell holds
    over ``32 * want``, so that a dense spot of a group does not meet itself as a whole.
    """
    extents = [F.max(d) - F.min(d) for d in dims]
    g = targets.groupBy(*group).agg(F.count("*").alias("n"), F.greatest(*extents).alias("w"), *[e.alias(f"e{i}") for i, e in enumerate(extents)])
    volume = F.lit(1.0)
    for i in range(len(dims)):
        volume = volume * F.greatest(f"e{i}", F.col("w") / 100)
    side = F.pow(volume * want / F.col("n"), F.lit(1.0 / len(dims)))
    sides = saved(g.select(*group, F.when(F.col("w") > 0, side).otherwise(1.0).alias("side"), "n"), "sides")
    while True:
        full = targets.join(sides, group).groupBy(*group, *[cell(F.col(d), F.col("side")).alias(f"c{i}") for i, d in enumerate(dims)]).count()
        dense = saved(full.groupBy(*group).agg(F.max("count").alias("most")).filter(F.col("most") > 32 * want), "dense")
        if not dense.limit(1).count():
            return sides
        halved = F.when(F.col("most").isNotNull(), F.col("side") / 2).otherwise(F.col("side"))
        sides = saved(sides.join(dense, group, "left").select(*group, halved.alias("side"), "n"), "sides")


#: Targets that a block of the search holds at the mean density, seekers of a block beyond which it is dealt to
#: several tasks, rows of a block at which its targets are thinned out, and distances that are computed at once.
BLOCK, SEEKERS, HELD, AT_ONCE = 512, 8192, 65536, 1 << 20


def _closest(s: np.ndarray, own: np.ndarray | None, t: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeker, target and distance of each seeker's k nearest targets with another key, by distance and key."""
    order = np.argsort(keys, kind="stable")
    t, keys = t[order], keys[order]
    step, out = max(1, AT_ONCE // max(1, len(t))), []
    for a in range(0, len(s), step):
        d = np.zeros((len(s[a : a + step]), len(t)))
        for i in range(s.shape[1]):
            by = s[a : a + step, i, None] - t[None, :, i]
            by *= by
            d += by
        if own is not None:
            d[own[a : a + step, None] == keys[None, :]] = np.nan
        most = np.partition(d, k - 1, axis=1)[:, k - 1, None] if len(t) > k else np.full((len(d), 1), np.inf)
        # squares that differ by an ulp or two can have the same root
        r, c = np.nonzero(d <= np.where(np.isnan(most), np.inf, most * (1 + 1e-15)))
        v = np.sqrt(d[r, c])
        at = np.lexsort((c, v, r))
        r, c, v = r[at], c[at], v[at]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((r[first] + a, order[c[first]], v[first]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _parts(s: np.ndarray, t: np.ndarray, h: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of seekers and targets of the parts of a large block: seekers halved along their widest side, with the targets within ``h`` of them."""
    todo = [(np.arange(len(s)), np.arange(len(t)))]
    while todo:
        a, b = todo.pop()
        if len(a) <= 24 or len(a) * len(b) <= 8192:
            yield a, b
            continue
        xs = s[a]
        i = int(np.argmax(xs.max(axis=0) - xs.min(axis=0)))
        a = a[np.argsort(xs[:, i], kind="stable")]
        at = t[b, i]
        for half in (a[: len(a) // 2], a[len(a) // 2 :]):
            lo, hi = s[half[0], i] - h, s[half[-1], i] + h
            todo.append((half, b[(at >= lo) & (at <= hi)]))


def _block_search(block: list[str], places: list[str], k: int, own: bool, mine: list[str], theirs: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each seeker's k nearest targets of its block, from rows sorted by block with seekers (``__role`` 0) before targets.

    Gives the seekers' columns ``mine``, whether they are ``settled``, and lists of the targets' columns ``theirs`` and of ``d``.
    A block is read in batches. Beyond ``HELD`` rows only targets that are among some seeker's k nearest so far are kept.
    """

    def found(rows: pa.Table, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers of seekers, how many targets each has, and of all these the row numbers and distances."""
        role = rows["__role"].to_numpy()
        xs = np.stack([rows[c].to_numpy() for c in places], axis=1)
        keys = rows["__tk"]
        if keys.null_count:  # seekers without keys of their own
            known = keys.drop_null()
            keys = keys.fill_null(known[0]) if len(known) else pa.chunked_array([np.zeros(len(keys), "int64")])
        keys = keys.to_numpy()
        if keys.dtype == object:
            keys = np.unique(keys, return_inverse=True)[1]
        reach = rows["__h"].to_numpy()
        who, many, at, far = [], [], [], []
        for a, b in bounds:
            m = a + int(np.searchsorted(role[a:b], 1))
            for p, q in _parts(xs[a:m], xs[m:b], reach[a]) if m > a else ():
                p, q = p + a, q + m
                r, c, v = _closest(xs[p], keys[p] if own else None, xs[q], keys[q], k)
                who.append(p)
                many.append(np.bincount(r, minlength=len(p)))
                at.append(q[c])
                far.append(v)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return join(who, "int64"), join(many, "int64"), join(at, "int64"), join(far, "float64")

    def result(rows: pa.Table, bounds: list[tuple[int, int]]) -> pa.RecordBatch:
        who, many, at, far = found(rows, bounds)
        seekers, targets = rows.select([*mine, "__h"]).take(who), rows.select(theirs).take(at)
        ends = np.concatenate([[0], np.cumsum(many)]).astype("int32")
        last = np.full(len(who), np.inf)
        last[many > 0] = far[ends[1:][many > 0] - 1]
        have, h = seekers["__have"].to_numpy(), seekers["__h"].to_numpy()
        settled = ((many >= k) & (last <= h * 0.999)) | (many >= have)
        lists = [pa.ListArray.from_arrays(pa.array(ends), c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in [*targets.columns, pa.array(far)]]
        return pa.Table.from_arrays([*seekers.select(mine).columns, pa.array(settled), *lists], [*mine, "settled", *theirs, "d"]).combine_chunks()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, most = None, HELD
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            if not rows.num_rows:
                continue
            new = np.zeros(rows.num_rows - 1, bool)
            for c in block:
                new |= pc.not_equal(rows[c][1:], rows[c][:-1]).to_numpy().astype(bool)
            starts = [0, *(np.flatnonzero(new) + 1).tolist()]
            if len(starts) > 1:
                yield from result(rows.slice(0, starts[-1]), list(zip(starts, starts[1:]))).to_batches()
                most = HELD
            held = rows.slice(starts[-1])
            if held.num_rows > most:
                who, _, at, _ = found(held, [(0, held.num_rows)])
                if len(at):
                    held = held.take(np.concatenate([who, np.unique(at)]))
                most = max(HELD, 2 * held.num_rows)
        if held is not None and held.num_rows:
            yield from result(held, [(0, held.num_rows)]).to_batches()

    return kernel


def nearest_lists(points: DataFrame, targets: DataFrame, group: list[str], dims: list[str], key: str, target_key: str, k: int, *, rest: list[str] | None = None, place: bool = False) -> DataFrame:
    """A row for each point (with ``key`` = ``target_key``) or each place of points, with lists of its k nearest targets' keys and
    distances, ``__tk`` and ``d``, of their ``rest`` columns and, with ``place``, their coordinates. See ``nearest``.
    """
    extra, own = [f"__r{c}" for c in rest or []], key == target_key
    at, xs, cells = ([f"{p}{i}" for i in range(len(dims))] for p in ("__t", "__x", "__c"))
    real = [F.col(d).cast("double").alias(x) for d, x in zip(dims, xs)]
    finite = reduce(and_, (F.abs(F.col(c)) < float("inf") for c in xs))  # NaN counts as greater than infinity
    t0 = targets.select(*group, F.col(target_key).alias("__tk"), *real, *[F.col(c).alias(e) for c, e in zip(rest or [], extra)]).dropna(subset=[*group, "__tk", *xs]).filter(finite)
    first = Window.partitionBy(*group, *xs).orderBy("__tk")
    t0 = saved(t0.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= k + int(own)).drop("__n"), "targets")
    # a ball of the side's radius holds k targets for most points: a circle has 3.1, a ball 4.2 sides of volume
    want = 0.75 * k if len(dims) == 2 else 0.5 * k
    sides = cell_sides(t0, group, xs, want)
    wide = max(2, round((BLOCK / want) ** (1 / len(dims))))
    seekers = points.select(*group, *([F.col(key).alias("__tk")] if own else []), *real).dropna().filter(finite)
    left = (seekers if own else seekers.distinct()).join(sides.withColumn("__have", F.col("n") - int(own)).filter("__have > 0").drop("n"), group)
    mine = [*group, *(["__own"] if own else []), *xs, "side", "__have"]
    theirs = ["__tk", *extra, *([*at] if place else [])]
    block = [*group, *cells, "__salt"]
    done, times = None, 1
    while True:
        h = F.col("side") * times
        home = lambda x: cell(x, h * wide)  # noqa: B023, E731
        seek = left.select("*", *[home(F.col(x)).alias(c) for x, c in zip(xs, cells)])
        # at most one in SEEKERS rows is such a block
        crowded = F.broadcast(seek.groupBy(*group, *cells).count().filter(F.col("count") > SEEKERS).select(*group, *cells, F.ceil(F.col("count") / SEEKERS).cast("int").alias("__many")))
        seek = seek.join(crowded, [*group, *cells], "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*(["__tk"] if own else xs)), "__many").cast("int"), F.lit(0)))
        t = t0.join(sides.drop("n"), group)
        for x, c in zip(xs, cells):
            t = t.select("*", F.explode(F.sequence(home(F.col(x) - h), home(F.col(x) + h))).alias(c))
        if times > 1:
            t = t.join(seek.select(*group, *cells).distinct(), [*group, *cells], "left_semi")
        t = t.join(crowded, [*group, *cells], "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__many", F.lit(1)) - 1)))
        key_type = t0.schema["__tk"].dataType
        seek = seek.select(*block, F.lit(0).alias("__role"), *xs, (F.col("__tk") if own else F.lit(None).cast(key_type)).alias("__tk"), h.alias("__h"), "side", "__have", *[F.lit(None).cast(t0.schema[e].dataType).alias(e) for e in extra])
        t = t.select(*block, F.lit(1).alias("__role"), *xs, "__tk", F.lit(None).cast("double").alias("__h"), F.lit(None).cast("double").alias("side"), F.lit(None).cast("long").alias("__have"), *extra)
        rows = seek.union(t).repartition(*block).sortWithinPartitions(*block, "__role").withColumn("__own", F.col("__tk")).withColumns({a: F.col(x) for a, x in zip(at, xs)})
        kinds = {f.name: f.dataType for f in rows.schema}
        made = StructType([*[StructField(c, kinds[c]) for c in mine], StructField("settled", BooleanType()), *[StructField(c, ArrayType(kinds[c])) for c in theirs], StructField("d", ArrayType(DoubleType()))])
        found = saved(rows.mapInArrow(_block_search(block, xs, k, own, mine, theirs), made), "nearest")
        part = found.filter("settled")
        done = part if done is None else done.unionByName(part)
        left = found.filter(~F.col("settled")).select(*group, *([F.col("__own").alias("__tk")] if own else []), *xs, "side", "__have")
        if not left.limit(1).count():
            break
        times *= 2
    names = {x: d for x, d in zip(xs, dims)} | {a: f"__t{d}" for a, d in zip(at, dims)} | ({"__own": key} if own else {})
    return done.drop("settled", "side", "__have").withColumnsRenamed(names)


def nearest(points: DataFrame, targets: DataFrame, group: list[str], dims: list[str], key: str, target_key: str, k: int, *, rest: list[str] | None = None, place: bool = False) -> DataFrame:
    """The k nearest targets of each point: ``key, target_key, d, rk`` (ties by target key), with ``place`` both coordinates too.

    Space is cut into blocks of several cells a side. A point is sent to its own block, a target to each block that is
    within a cell's side of it, and a block is searched at once (``_block_search``), so no pairs are shuffled. A point is
    settled if its k-th target is within a cell's side, or if it has met its whole group; the points that are left are searched
    for in cells and blocks of twice the side. Sides follow the targets' density (``cell_sides``), and a block with many
    seekers is dealt to several tasks. Of targets at one place only the ``k`` (with ``key`` = ``target_key``: ``k + 1``) first
    keys can be among the nearest, and points at one place that look for others' keys share their search. Rows with a
    null, NaN or infinite coordinate, a null group or a null key, and points of a group without targets, are left out.
    """
    own = key == target_key
    lists = nearest_lists(points, targets, group, dims, key, target_key, k, rest=rest, place=place)
    who = [*group, *([key] if own else []), *(dims if place or not own else [])]
    fields = ["__tk", "d", *[f"__r{c}" for c in rest or []], *([f"__t{d}" for d in dims] if place else [])]
    rows = lists.select(*who, F.posexplode(F.arrays_zip(*fields)).alias("__i", "__n"))
    names = {"__tk": "neighbour" if own else target_key} | {f"__r{c}": f"t_{c}" for c in rest or []}
    found = rows.select(*who, (F.col("__i") + 1).alias("rk"), *[F.col(f"__n.{f}").alias(names.get(f, f)) for f in fields])
    if own:
        return found
    mine = points.select(*group, key, *[F.col(d).cast("double").alias(d) for d in dims])
    out = mine.join(found, [*group, *dims])
    return out if place else out.drop(*dims)
