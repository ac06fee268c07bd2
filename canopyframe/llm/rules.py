"""Quality rules as a short-circuit cascade.

Base counts are taken of every text. A text that the base rules pass then meets the further rules
one by one until one rejects it. Their order is settled beforehand on a sample: each rule's cost and
rejections are measured there, and rules run by falling rejections per second. The verdict is the
same under any order; the order decides how little of the work is done.

Scale. One pass over the texts, no shuffle. The sample is ``SAMPLE`` rows at any size: their ids come
from a top-k over hashed ids, and the measuring runs in tasks.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.textio import byte_slices, space_words

#: Rows on which costs and selectivities are estimated.
SAMPLE = 400
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of words in repeated 3-word windows

_CONTINUATION = np.arange(0x80, 0xC0)
_SPACES = np.array([0x20, *range(0x09, 0x0E)])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_UPPER = np.arange(0x41, 0x5B)
_LOWER = np.arange(0x61, 0x7B)
_DIGITS = np.arange(0x30, 0x3A)


class Doc:
    """A text's statistics, each worked out when first asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return space_words(self.text)

    @cached_property
    def bytes(self) -> np.ndarray:
        return np.bincount(np.frombuffer(self.text, np.uint8), minlength=256)

    def count(self, codes: np.ndarray) -> int:
        return int(self.bytes[codes].sum())

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - self.count(_CONTINUATION) - self.count(_SPACES)

    @cached_property
    def n_symbols(self) -> int:
        return self.count(_SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        times = Counter(windows)
        again = np.fromiter((times[x] > 1 for x in windows), bool, len(windows))
        hit = np.zeros(len(w), bool)
        for shift in range(3):
            hit[shift : shift + len(again)] |= again
        return int(hit.sum())

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words

    @cached_property
    def top_word(self) -> int:
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def distinct_words(self) -> int:
        return len(set(self.words))


#: Name and rejection test, integers only so that SQL can say the same.
RULES: dict[str, Callable[[Doc], bool]] = {
    "symbols": lambda d: 10 * d.n_symbols > d.n_words,
    "shouting": lambda d: 10 * d.count(_UPPER) > 4 * (d.count(_UPPER) + d.count(_LOWER)),
    "exclaiming": lambda d: 10 * int(d.bytes[0x21]) > d.n_words,
    "digits": lambda d: 10 * d.count(_DIGITS) > 3 * d.word_chars,
    "word_length": lambda d: d.word_chars < 2 * d.n_words or d.word_chars > 15 * d.n_words,
    "dup_lines": lambda d: 10 * d.n_dup_lines > 6 * len(d.lines),
    "top_word": lambda d: 10 * d.top_word > 3 * d.n_words,
    "few_distinct": lambda d: 20 * d.distinct_words < d.n_words,
}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict[str, tuple[float, float]]:
    """Seconds and share of rejections per text for each rule, on the sample of base-passing texts."""
    ids = docs.select(F.col(id_col).alias("k")).filter("k IS NOT NULL").orderBy(F.xxhash64("k"), "k").limit(sample)
    texts = docs.join(F.broadcast(ids.distinct()), F.col(id_col) == F.col("k"), "left_semi").select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected, seen = Counter(), Counter(), 0
        for b in batches:
            for x in (x for part in byte_slices(b.column(0)) for x in part):
                if Doc(x).base_failed:
                    continue
                seen += 1
                for name, test in RULES.items():
                    fresh = Doc(x)
                    fresh.base_failed  # these statistics are there for every rule
                    began = time.perf_counter()
                    rejected[name] += test(fresh)
                    spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(RULES), "spent": [float(spent[r]) for r in RULES], "rejected": [int(rejected[r]) for r in RULES], "seen": [seen] * len(RULES)})

    rows = texts.mapInArrow(run, "rule string, spent double, rejected long, seen long").groupBy("rule").agg(F.sum("spent").alias("s"), F.sum("rejected").alias("r"), F.sum("seen").alias("n")).collect()
    return {r.rule: (r.s / max(1, r.n), r.r / max(1, r.n)) for r in rows}


def cascade_order(measured: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by falling rejections per cost; unmeasured ones keep their place after."""
    rate = lambda r: -(measured.get(r, (0, 0))[1] / max(measured.get(r, (1, 0))[0], 1e-9))
    return sorted(RULES, key=rate)


RESULT = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,kept:boolean,rejected_by:string,rules_run:int>"


def verdict_column(text: Column, order: list[str]) -> Column:
    """Base counts and the cascade's verdict; ``rejected_by`` names the first rule that objects."""

    @F.arrow_udf(RESULT)
    def kernel(texts: pa.Array) -> pa.Array:
        rows = []
        for part in byte_slices(texts):
            for x in part:
                d = Doc(x)
                by, run = ("base" if d.base_failed else None), 0
                if by is None:
                    for run, name in enumerate(order, 1):
                        if RULES[name](d):
                            by = name
                            break
                rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed, by is None, by, run))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string(), pa.int32()]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by", "rules_run"]
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return kernel(text)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: its id, base counts, ``base_failed``, ``kept``, ``rejected_by``, ``rules_run``.

    A null or empty text has no words and fails the base. Rows with a null id and repeated rows stay.
    Other columns are not looked at. An empty table gives an empty result (rules in listed order).
    Texts are read whole. Rules of equal rate run in listed order.
    """
    order = cascade_order(measure(docs, id_col, text_col, sample))
    return docs.select(F.col(id_col), verdict_column(F.col(text_col), order).alias("v")).select(id_col, "v.*")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_extract_all(t, '[^\x{20}\x{09}-\x{0D}]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x{20}\x{09}-\x{0D}]') GROUP BY doc_id),
f AS (SELECT doc_id, max(c) AS top, count(*) AS uniq FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY doc_id, x) GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x{20}\x{09}-\x{0D}]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        coalesce(l.n_lines, 0) AS n_lines, coalesce(f.top, 0) AS top, coalesce(f.uniq, 0) AS uniq,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS up, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS low,
        length(t) - length(replace(t, '!', '')) AS bang, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS dig
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN f USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * up > 4 * (up + low) OR 10 * bang > n_words OR 10 * dig > 3 * word_chars
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > 6 * n_lines OR 10 * top > 3 * n_words OR 20 * uniq < n_words) AS kept
FROM b
"""
