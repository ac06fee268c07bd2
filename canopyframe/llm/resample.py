"""Target-distribution importance resampling of documents.

A document's features are the runs of 1 to ``most`` consecutive normalised words, hashed into ``BUCKETS``
buckets. How much more common a bucket is in the target than in the corpus is its gain, in thousandths of
a natural logarithm; a document's weight is the floored mean of its features' gains, and Gumbel noise drawn
from its id turns the highest scores into a sample without replacement. What is drawn ends at an exact
cutoff key, found by a weighted median of medians: each partition tells the median of its remaining keys,
the median of these, weighted by how many keys remain in each partition, is the pivot, and the side that
cannot hold the cutoff goes, which is at least a quarter of the remaining keys each round.

Scale. Two passes over the texts, none of which shuffles them: partitions add up bucket counts in an array,
of which ``BUCKETS`` rows a partition are summed, and score rows against an array of ``BUCKETS`` gains, the
only thing that goes to executors. Scores are checkpointed as rows of five numbers. A round of the
selection brings one row a partition to the driver, whose keys a task holds one partition at a time; the
number of rounds grows with the logarithm of the distinct keys. Equal scores are cut by a second selection
on the id. Only the winners are sorted, by range partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from canopyframe.llm.decontaminate import normal_words
from canopyframe.llm.textio import byte_slices
from canopyframe.plans.lineage import cut
from canopyframe.plans.ranking import global_row_number

BUCKETS = 10_000
#: Per cent of the eligible documents that are drawn, and the words that make one eligible.
SHARE, LEAST_WORDS = 10, 20
SEED = 2024
#: Longest run of words that is a feature.
MOST = 1
#: Words whose bucket a task remembers; a word beyond them is hashed again.
CACHE = 500_000


class Buckets(dict):
    """Bucket of each word, found once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[word] = zlib.crc32(word) % BUCKETS
        return n


def features(words: list[bytes], most: int) -> list[bytes]:
    return words if most == 1 else [b" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def bucket_counts(texts: DataFrame, text_col: str, most: int = MOST) -> np.ndarray:
    """How many features of all texts lie in each bucket."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bucket = np.zeros(BUCKETS, np.int64), Buckets()
        for batch in batches:
            for part in byte_slices(batch.column(0)):
                for text in part:
                    found = features(normal_words(text), most)
                    np.add.at(total, np.fromiter(map(bucket.__getitem__, found), np.int64, len(found)), 1)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).alias("t")).mapInArrow(kernel, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed shares' ratio, by bucket."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weight_column(text: Column, gains: np.ndarray, most: int = MOST) -> Column:
    """``struct<n_words, n_features, weight>``."""

    @F.arrow_udf("struct<n_words:bigint,n_features:bigint,weight:bigint>")
    def kernel(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bucket = Buckets()
        for batch in texts:
            n_words, n, weight = [], [], []
            for words in map(normal_words, chain.from_iterable(byte_slices(batch))):
                found = features(words, most)
                total = int(gains[np.fromiter(map(bucket.__getitem__, found), np.int64, len(found))].sum())
                n_words.append(len(words))
                n.append(len(found))
                weight.append(total // len(found) if found else 0)
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n_words, n, weight)], ["n_words", "n_features", "weight"])

    return kernel(text)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of seed and id; a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted_median(medians: list[tuple[int, object]]) -> object:
    """The least of ``(weight, value)``'s values such that it and smaller ones hold half of the weight."""
    medians, so_far = sorted(medians, key=lambda x: x[1]), 0
    total = sum(n for n, _ in medians)
    for n, value in medians:
        so_far += n
        if 2 * so_far >= total:
            return value


def _sides(pivot: object, kind: pa.DataType) -> Callable:
    """A partition's keys on either side of ``pivot``: number and median; without one, all are above."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = pa.chunked_array([b.column(0) for b in batches], kind)
        sides = {1: keys}
        if pivot is not None:
            at = pa.scalar(pivot, kind)
            sides = {-1: keys.filter(pc.less(keys, at)), 0: keys.filter(pc.equal(keys, at)), 1: keys.filter(pc.greater(keys, at))}
        sides = {k: v for k, v in sides.items() if len(v)}
        middle = [v[pc.sort_indices(v)[(len(v) - 1) // 2].as_py()].as_py() for v in sides.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sides), pa.int32()), pa.array(map(len, sides.values()), pa.int64()), pa.array(middle, kind)], ["side", "n", "median"])

    return kernel


def cutoff(keys: DataFrame, take: int) -> tuple[object, int]:
    """The key that stands at place ``take`` (from 1) in ascending order, and how many keys are less.

    ``keys`` has one column of an orderable type without nulls, and at least ``take`` rows.
    """
    name, kind = keys.columns[0], keys.schema[0].dataType

    def sides(left: DataFrame, pivot: object) -> dict[int, list[tuple[int, object]]]:
        out: dict[int, list[tuple[int, object]]] = {-1: [], 0: [], 1: []}
        for r in left.mapInArrow(_sides(pivot, to_arrow_type(kind)), f"side int, n long, median {kind.simpleString()}").collect():  # three rows a partition at most
            out[r["side"]].append((r["n"], r["median"]))
        return out

    before, left = 0, keys
    pivot = weighted_median(sides(left, None)[1])
    while True:
        found = sides(left, pivot)
        less, equal = (sum(n for n, _ in found[k]) for k in (-1, 0))
        if take <= before + less:
            left, pivot = left.filter(F.col(name) < F.lit(pivot)), weighted_median(found[-1])
        elif take <= before + less + equal:
            return pivot, before + less
        else:
            before += less + equal
            left, pivot = left.filter(F.col(name) > F.lit(pivot)), weighted_median(found[1])


def _scored(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, most: int, least_words: int, seed: int, keep: dict[str, Column]) -> DataFrame:
    """``keep`` and ``id, n_features, weight, score, fit``."""
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(id_col).alias("id"), weight_column(F.col(text_col), gains, most).alias("w"))
    return rows.select(*keep, "id", "w.n_features", "w.weight", (F.col("w.weight") + noise(F.col("id"), seed)).alias("score"), (F.col("w.n_words") >= least_words).alias("fit"))


def _last_drawn(rows: DataFrame, share: int) -> tuple[Column, int]:
    """Condition of rows that may be drawn, and how many are; more meet it only where the last one is repeated."""
    fit = rows.filter("fit")
    take = fit.count() * share // 100
    if not take:
        return F.lit(False), 0
    low, better = cutoff(fit.select((-F.col("score")).alias("k")), take)
    tied = fit.filter(F.col("score") == -low).select("id").filter(F.col("id").isNotNull())
    need = take - better
    last = F.lit(True)  # rows with a null id come after the others of their score
    if need <= tied.count():
        last = F.coalesce(F.col("id") <= F.lit(cutoff(tied, need)[0]), F.lit(False))
    return F.col("fit") & ((F.col("score") > -low) | (F.col("score") == -low) & last), take


def _gains(docs: DataFrame, target: DataFrame, text_col: str, target_text: str, most: int) -> np.ndarray:
    return bucket_gains(bucket_counts(docs, text_col, most), bucket_counts(target, target_text, most))


def importance_scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: ``id_col, n_features, weight, score, rank`` (null if not drawn).

    A null text has no features and a weight of zero; a row without ``least_words`` words cannot be drawn.
    Rows with a null id stand after others of their score. Repeated rows stay and are drawn each for itself.
    Ids may be of any orderable type. An empty table gives an empty result, an empty target smooth gains.
    Other columns are not looked at. Texts are read whole.
    """
    gains = _gains(docs, target, text_col, target_text, most)
    rows = cut(_scored(docs, gains, id_col, text_col, most, least_words, seed, {}))
    may, take = _last_drawn(rows, share)
    # the row's place in the checkpoint tells repeated rows apart, so that they can be dealt to several ranges
    winners = rows.filter(may).withColumn("place", F.monotonically_increasing_id())
    ranked = global_row_number(winners, [F.desc("score"), F.asc_nulls_last("id"), F.col("place")], name="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank"))).drop("place")
    out = ranked.unionByName(rows.filter(~may).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with their own columns, told by the cutoff key in one more pass without a shuffle.

    As ``importance_scores`` draws them; repeats of the last drawn row are all given.
    """
    gains = _gains(docs, target, text_col, target_text, most)
    may, _ = _last_drawn(cut(_scored(docs, gains, id_col, text_col, most, least_words, seed, {}).select("id", "score", "fit")), share)
    # the document's columns ride in a struct, so that no name of theirs can clash
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    return _scored(docs, gains, id_col, text_col, most, least_words, seed, {"row": row}).filter(may).select("row.*")


_WORDS = r"list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '')"
SQL = rf"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM d) GROUP BY w),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY w),
word AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
code AS (SELECT w, xor(4294967295, list_reduce(range(0, length(h) // 2), lambda c, k: xor(c >> 8, t[(xor(c, CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT)) & 255) + 1]), 4294967295)) % 10000 AS b FROM word, tab),
st AS (SELECT b, coalesce(sum(dw.n), 0) AS s, coalesce(sum(bw.n), 0) AS t FROM code LEFT JOIN dw USING (w) LEFT JOIN bw USING (w) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + 10000) / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS g FROM st),
means AS (SELECT doc_id, count(*) AS n, floor(sum(g) / count(*)) AS weight FROM (SELECT doc_id, unnest(w) AS w FROM d) JOIN code USING (w) JOIN gain USING (b) GROUP BY doc_id),
scores AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM d LEFT JOIN means USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS n FROM scores)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked
"""
