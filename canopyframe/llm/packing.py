"""Best-fit packing of documents into sequences, improved by swap-based local search.

A document is its token ids and a final id 0. One longer than a sequence is cut from its end into
whole sequences, which need no packing; its first piece, like every shorter document, is packed.

Scale. Python sees texts only to count and check-sum their ids; then a piece is a row of numbers.
Pieces are dealt by hash into groups of about ``GROUP`` pieces whatever the input (so any group fits
one task), and each group is packed by best fit decreasing and local search. What a group leaves
unfilled depends on its lengths alone, so it is the same share at every size: next to nothing where
there are short pieces, more where hardly two pieces fit together.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.textio import SLICE_ROWS
from canopyframe.plans.lineage import cut

CAPACITY = 2048
#: Pieces that one task packs, about.
GROUP = 16_384
#: The id that ends a document.
END = 0
VOCABULARY = "byte_bpe_50k.json"
PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
#: White space too long for the fast encoder's splitter, whose stack is bounded.
LONG_SPACE = r"\s{5000}"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if printable, else 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE vocabulary in the JSON form of the ``tokenizers`` library.

    Texts go to tiktoken, which is some times faster, with the same vocabulary; those that hold an added
    token or very long white space, which it treats otherwise, go to the ``tokenizers`` library itself.
    """

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = vocabulary or public_tokenizers.path(VOCABULARY)
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        added = {x["content"] for x in form["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in form["model"]["vocab"].items() if piece not in added}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(path)
        self.odd = re.compile("|".join([LONG_SPACE, *map(re.escape, sorted(added))]))

    def __call__(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids if self.odd.search(text) else self.fast(text)


def cut_pieces(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids, of four bytes each."""
    n = len(ids) // 4
    first = n % capacity or capacity
    bounds = [0, *range(first, n + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]


_encoders: dict[str | None, Encoder] = {}


def piece_column(text: Column, capacity: int = CAPACITY, vocabulary: str | None = None) -> Column:
    """The pieces of a text's ids; a null text counts as empty and so has the end id alone."""
    end = int(END).to_bytes(4, "little")

    @F.arrow_udf(PIECES)
    def kernel(texts: pa.Array) -> pa.Array:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(vocabulary)
        encode, rows = _encoders[vocabulary], []
        for at in range(0, len(texts), SLICE_ROWS):
            for x in texts.slice(at, SLICE_ROWS).to_pylist():
                rows.append(cut_pieces(array("I", encode(x or "")).tobytes() + end, capacity))
        flat = [x for r in rows for x in r]
        columns = list(zip(*flat)) or [(), (), (), ()]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["piece", "start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)

    return kernel(text)


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: items by falling size, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g is set while some bin has a gap of g
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = gaps >> sizes[i]
        if fits:
            gap = sizes[i] + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        rest = gap - sizes[i]
        if rest:
            by_gap[rest].append(b)
            gaps |= 1 << rest
    return bins


class _Backs:
    """What underfull bins can give back in an exchange: a row for each item (or pair) of distinct size of a bin.

    Rows keep the fill that their bin had, which stays right because a bin's rows are voided when it changes.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int], fill: np.ndarray, pairs: bool, capacity: int):
        self.bins, self.sizes, self.fill, self.pairs, self.capacity = bins, sizes, fill, pairs, capacity
        self._build()

    def _rows(self, b: int) -> list[tuple[int, int, int, int]]:
        """(bin, size, item, other item or -1); a full bin has none."""
        one, two = {}, {}
        if self.fill[b] >= self.capacity:
            return []
        for i in self.bins[b]:
            if self.sizes[i] in one:
                two.setdefault(self.sizes[i], i)
            one.setdefault(self.sizes[i], i)
        if not self.pairs:
            return [(b, x, i, -1) for x, i in one.items()]
        sums = {x + y: (i, j) for (x, i), (y, j) in combinations(one.items(), 2)}
        sums |= {2 * x: (one[x], j) for x, j in two.items()}
        return [(b, x, i, j) for x, (i, j) in sums.items()]

    def _build(self) -> None:
        self.place = [(0, 0)] * len(self.bins)
        of = [self._rows(b) for b in range(len(self.bins))]
        many = sum(map(len, of))
        self.n, self.table, self.level = 0, np.zeros((4, 2 * many + 1024), np.int64), np.zeros(2 * many + 1024, np.int64)
        at = 0
        for b, rows in enumerate(of):
            self.place[b] = (at, at + len(rows))
            at += len(rows)
        self.table[:, :many] = np.array([r for rows in of for r in rows], np.int64).reshape(-1, 4).T
        self.level[:many] = self.fill[self.table[0, :many]]
        self.n = many

    def changed(self, b: int) -> None:
        low, high = self.place[b]
        self.level[low:high] = -1
        rows = self._rows(b)
        if self.n + len(rows) > len(self.level):
            self._build()
            return
        self.place[b] = (self.n, self.n + len(rows))
        if rows:
            self.table[:, self.n : self.n + len(rows)] = np.array(rows, np.int64).T
            self.level[self.n : self.n + len(rows)] = self.fill[b]
            self.n += len(rows)

    def best(self, outs: np.ndarray, giver: int) -> tuple[int, int, int, tuple[int, ...]]:
        """(gain, bin, size out, items back) of the best exchange for one of the sorted sizes ``outs``."""
        low = self.fill[giver]
        rows = np.flatnonzero((self.level[: self.n] >= low) & (self.table[1, : self.n] < outs[-1]))
        rows = rows[self.table[0, rows] != giver]
        if not len(rows):
            return 0, -1, 0, ()
        level, size = self.level[rows], self.table[1, rows]
        room = self.capacity - level + size
        # the gain grows with what is shifted, so of a row's fitting sizes the largest is its best
        out = outs[np.maximum(np.searchsorted(outs, room, "right") - 1, 0)]
        shift = out - size
        gain = np.where((shift > 0) & (out <= room), shift * (level - low + shift), 0)
        k = int(gain.argmax())
        if gain[k] == 0:
            return 0, -1, 0, ()
        b, back, i, j = self.table[:, rows[k]].tolist()
        return int(gain[k]), b, back + int(shift[k]), (i,) if j < 0 else (i, j)


def local_search(bins: list[list[int]], sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Empties bins by moves, one-for-one and two-for-one exchanges between underfull bins.

    The emptiest bin gives: each step moves fill from it into a fuller underfull bin, by the step that
    raises the sum of squared fills most, so every step raises that integer sum and the search ends.
    Rounds over the bins, the emptiest first, go on until a round finds no step; emptied bins go. Items of
    one size are alike, so each distinct size (and sum of two) of a bin is tried once. A bin is looked at
    again only after a step elsewhere; each look is a few passes over arrays of what the bins hold.
    """
    bins = [list(b) for b in bins]
    fill = np.array([sum(sizes[i] for i in b) for b in bins], np.int64)
    ones, twos = (_Backs(bins, sizes, fill, pairs, capacity) for pairs in (False, True))
    steps, seen = 0, [-1] * len(bins)

    def step(giver: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """(bin, items out, items back), or None."""
        one = {sizes[i]: (i,) for i in bins[giver]}
        two = {2 * sizes[i]: (i, j) for i, j in combinations(bins[giver], 2) if sizes[i] == sizes[j]} if len(one) < len(bins[giver]) else {}
        two |= {x + y: (i, j) for (x, (i,)), (y, (j,)) in combinations(one.items(), 2)}
        single, any_out = np.array(sorted(one)), np.array(sorted(one.keys() | two.keys()))
        best = (0, -1, (), ())
        takers = np.flatnonzero((fill >= fill[giver]) & (fill <= capacity - single[0]))
        takers = takers[takers != giver]
        if len(takers):
            out = single[np.searchsorted(single, capacity - fill[takers], "right") - 1]
            gain = out * (fill[takers] - fill[giver] + out)
            k = int(gain.argmax())
            best = (int(gain[k]), int(takers[k]), one[int(out[k])], ())
        if best[0] == 0 or len(bins[giver]) > 1:
            got, b, size, back = ones.best(any_out, giver)
            if got > best[0]:
                best = (got, b, one.get(size) or two[size], back)
            got, b, size, back = twos.best(single, giver)
            if got > best[0]:
                best = (got, b, one[size], back)
        return best[1:] if best[0] else None

    while True:
        before = steps
        for giver in np.argsort(fill, kind="stable").tolist():
            while 0 < fill[giver] < capacity and seen[giver] != steps:
                found = step(giver)
                if found is None:
                    seen[giver] = steps
                    break
                b, out, back = found
                for i in out:
                    bins[giver].remove(i)
                for i in back:
                    bins[b].remove(i)
                bins[b] += out
                bins[giver] += back
                shift = sum(sizes[i] for i in out) - sum(sizes[i] for i in back)
                fill[b] += shift
                fill[giver] -= shift
                for table in (ones, twos):
                    table.changed(b)
                    table.changed(giver)
                steps += 1
        if steps == before:
            return [b for b in bins if b]


def _pack_group(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        sizes = rows["length"].to_pylist()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, items in enumerate(local_search(best_fit(sizes, capacity), sizes, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = k, at
                at += sizes[i]
        sequence += rows["pack"].to_numpy() * 2**32
        return rows.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is the end id alone. Rows with a null id and repeated rows are packed like
    any other. Other columns are not looked at. An empty table gives an empty result. A very long
    text is cut into as many whole sequences as it fills. Equal lengths are packed in row order.
    """
    pieces = docs.select(F.col(id_col).alias("doc_id"), piece_column(F.col(text_col), capacity, vocabulary).alias("p"), F.monotonically_increasing_id().alias("row"))
    pieces = cut(pieces.select("doc_id", "row", F.explode("p").alias("p")).select("doc_id", "row", "p.*"))
    whole = pieces.filter(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = pieces.filter(F.col("length") < capacity)
    n = max(1, round(part.count() / group))
    dealt = part.withColumn("pack", F.pmod(F.xxhash64("row", "piece"), F.lit(n)).cast("long"))
    packed = dealt.groupBy("pack").applyInArrow(_pack_group(capacity), f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return whole.unionByName(packed).withColumnRenamed("doc_id", id_col)
