"""Secret scan with a battery of randomness tests, in DataFrame functions throughout.

Patterns find assignments, access keys and long hex runs (the base). Every other long run of encoding
characters is a candidate. Its body is its longest part between separators (``- _ / +``) if that is
long enough, else all of it without them, so that prefixes of keys, dashes of UUIDs and the like do
not hide what is random; the body's encoding is inferred from its characters. A secret must be

- random: three tests of the hypothesis that the body is uniform in its encoding (chi-squared
  against a uniform alphabet, runs above and below the alphabet's middle, lag-one serial
  correlation), joined by Fisher's method, do not reject it at level ``ALPHA``; and
- not ordinary: under the hypothesis of ordinary writing it would be surprising. Two tests are made of
  that: likelihood of the letters (low for letters that are not drawn as often as the corpus draws them) and changes between lower case, capitals and digits (more than ``CHANGES`` of all
  neighbours). Their joint p goes through the Benjamini-Hochberg step-up at level ``FDR`` within each
  band of encoding and length, so of the secrets reported at most about that share is ordinary
  writing; short bodies, on which the tests have little power, are not reported for want of evidence.

Scale. One pass over texts leaves spans and candidates, which are rare and are written once to the
checkpoint folder; letters are counted in a second pass, over all texts, into 36 numbers. Band
thresholds come from a histogram of p in steps of a tenth of a decade, so the step-up sorts a bounded
table (bands x ``STEPS``), not the candidates; it is conservative by a step at most. Candidates go
back to their rows by row number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.llm.spans import SPANS, as_spans, blocked, bound, count_kind, listed, matches, overlaps
from canopyframe.plans.lineage import cut

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
GROUP_2 = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = "AKIA[A-Z0-9]{16,}+"  # 20 characters with the prefix, which is of the same class
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
FDR = 0.05
#: Level at which a body is held not to be random.
ALPHA = 0.001
#: Least length of a part that stands for its candidate.
PART = 20
LEAST_BITS = 90
STEPS = 400

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the narrowest: name, what the characters must match, alphabet in its own order.
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("lower36", "^[0-9a-z]+$", _DIGITS + _LOWER),
    ("upper36", "^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
]
#: Share of neighbours in ordinary writing that differ in class: words of five letters and more with
#: capitals, and within one case numbers between words.
CHANGES = {"base62": 0.36}
CHANGES_ONE_CASE = 0.15
#: Part of an even share in the shares of letters.
EVEN = 0.2
#: Counts that each letter gets beforehand: a corpus of a few thousand letters tells little of what is ordinary.
PRIOR = 200


def base_spans(text: Column) -> Column:
    """Spans of assign, access and hex matches, sorted."""
    assign = matches(text, ASSIGN, text.rlike("(?i)passw|secret|token|api_?key"))
    assign = F.filter(assign, lambda x: F.length(F.regexp_extract(x["m"], GROUP_2, 1)) >= 6)
    access = matches(text, ACCESS, F.contains(text, F.lit("AKIA")))
    hexes = matches(text, HEX, text.rlike(HEX))
    return F.array_sort(F.concat(as_spans(assign, 0), as_spans(access, 1), as_spans(hexes, 2)))


def _tail(z: Column) -> Column:
    """P(Z > z) of the standard normal for z >= 0 (rational approximation, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def _upper_p(z: Column) -> Column:
    return F.when(z >= 0, _tail(z)).otherwise(1 - _tail(-z))


def battery(candidates: DataFrame) -> DataFrame:
    """Adds ``body, encoding, k, n, p_chi, p_runs, p_serial, p`` to rows with a ``token``; p is of randomness."""
    parts = F.transform(F.split("token", "[-_/+=]+"), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))
    longest = F.array_max(parts)
    body = F.when(longest["n"] >= PART, longest["x"]).otherwise(F.regexp_replace("token", "[-_/+=]", ""))
    pick = lambda part: F.coalesce(*[F.when(F.col("body").rlike(e[1]), F.lit(e[part])) for e in ENCODINGS])
    rows = candidates.withColumn("body", body).withColumn("encoding", pick(0)).withColumn("alphabet", pick(2))
    # a candidate of separators alone has no body and no encoding
    rows = rows.filter("encoding IS NOT NULL").withColumn("k", F.length("alphabet")).withColumn("n", F.length("body"))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    squares = F.aggregate(chars(F.col("alphabet")), F.lit(0.0), lambda a, c: a + F.pow(F.length("body") - F.length(F.replace(F.col("body"), c, F.lit(""))), F.lit(2.0)))
    rows = rows.withColumn("chi", squares * k / n - n)
    halves = F.concat(F.expr("repeat('0', cast(k / 2 as int))"), F.expr("repeat('1', k - cast(k / 2 as int))"))
    rows = rows.withColumn("bits", F.call_function("translate", F.col("body"), F.col("alphabet"), halves))
    ones = F.length(F.replace("bits", F.lit("0"), F.lit(""))).cast("double")
    rows = rows.withColumn("n1", ones).withColumn("runs", F.size(F.regexp_extract_all("bits", F.lit("0+|1+"), F.lit(0))).cast("double"))
    mu = 2 * F.col("n1") * (n - F.col("n1")) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    z_runs = F.when(var > 0, F.abs(F.col("runs") - mu) / F.sqrt(var)).otherwise(F.lit(38.0))
    codes = F.transform(chars(F.col("body")), lambda c: (F.call_function("instr", F.col("alphabet"), c) - 1).cast("double"))
    rows = rows.withColumn("codes", codes)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    mean = add(F.col("codes")) / n
    rows = rows.withColumn("mean", mean)
    off = F.transform("codes", lambda c: c - F.col("mean"))
    rows = rows.withColumn("off", off)
    spread = add(F.transform("off", lambda c: c * c))
    lagged = add(F.zip_with(F.slice("off", F.lit(1), F.size("off") - 1), F.slice("off", F.lit(2), F.size("off") - 1), lambda a, b: a * b))
    z_serial = F.when(spread > 0, F.abs(lagged / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(38.0))
    df = k - 1
    z_chi = (F.cbrt(F.greatest(F.col("chi"), F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    clamp = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(1e-300))
    rows = rows.withColumn("p_chi", clamp(_upper_p(z_chi))).withColumn("p_runs", clamp(2 * _tail(z_runs))).withColumn("p_serial", clamp(2 * _tail(z_serial)))
    half = -(F.ln("p_chi") + F.ln("p_runs") + F.ln("p_serial"))
    fisher = F.exp(-half) * (1 + half + half * half / 2)
    return rows.withColumn("p", clamp(fisher)).drop("alphabet", "chi", "bits", "n1", "runs", "codes", "mean", "off")


def letter_counts(docs: DataFrame, text_col: str) -> dict[str, int]:
    """How often all texts hold each digit and (case folded) each letter."""
    low = docs.select(F.lower(F.col(text_col)).alias("t"))
    chars = _DIGITS + _LOWER
    row = low.agg(*[F.sum(F.octet_length("t") - F.octet_length(F.replace("t", F.lit(c), F.lit("")))).alias(f"c{i}") for i, c in enumerate(chars)]).first()
    return {c: row[i] or 0 for i, c in enumerate(chars)}


def ordinary(tested: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Adds ``p_letters``, ``p_changes`` and their joint ``p_ordinary`` to rows of ``battery``.

    A body's letters are compared with letters drawn as the corpus draws those of its encoding: the sum of the
    logarithms of their shares (mixed with ``EVEN`` of an even share, so that a rare letter alone does not
    decide) is low for letters drawn evenly. The count of class changes is compared with a binomial.
    """
    n = F.col("n").cast("double")
    logs, moments = {}, {}
    for name, _, alphabet in ENCODINGS:
        letters = sorted(set(alphabet.lower()) - set(_DIGITS))
        total = sum(counts.get(c, 0) + PRIOR for c in letters)
        share = {c: (counts.get(c, 0) + PRIOR) / total for c in letters}
        log = {c: math.log((1 - EVEN) * x + EVEN / len(letters)) for c, x in share.items()}
        mean = sum(x * log[c] for c, x in share.items())
        logs[name] = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(x).alias("x")) for c, x in log.items()])
        moments[name] = (mean, sum(x * (log[c] - mean) ** 2 for c, x in share.items()), CHANGES.get(name, CHANGES_ONE_CASE))
    of = lambda i: F.coalesce(*[F.when(F.col("encoding") == name, F.lit(m[i])) for name, m in moments.items()])
    rows = tested.withColumn("mean", of(0)).withColumn("var", of(1)).withColumn("rate", of(2)).withColumn("low", F.regexp_replace(F.lower("body"), "[0-9]", ""))
    rows = rows.withColumn("logs", F.coalesce(*[F.when(F.col("encoding") == name, x) for name, x in logs.items()]))
    rate, many = F.col("rate"), F.length("low").cast("double")
    said = F.aggregate("logs", F.lit(0.0), lambda a, x: a + x["x"] * (F.length("low") - F.length(F.replace(F.col("low"), x["c"], F.lit("")))))
    z_letters = F.when(many * F.col("var") > 1e-9, (many * F.col("mean") - said) / F.sqrt(many * F.col("var"))).otherwise(F.lit(0.0))
    classes = F.call_function("translate", F.col("body"), F.lit(_DIGITS + _UPPER + _LOWER), F.lit("0" * 10 + "1" * 26 + "2" * 26))
    changes = F.size(F.regexp_extract_all(classes, F.lit("0+|1+|2+"), F.lit(0))) - 1
    z_changes = (changes - 0.5 - (n - 1) * rate) / F.sqrt((n - 1) * rate * (1 - rate))
    clamp = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(1e-300))
    rows = rows.withColumn("p_letters", clamp(_upper_p(z_letters))).withColumn("p_changes", clamp(_upper_p(z_changes)))
    half = -(F.ln("p_letters") + F.ln("p_changes"))
    return rows.withColumn("p_ordinary", clamp(F.exp(-half) * (1 + half))).drop("mean", "var", "rate", "low", "logs")


def thresholds(tested: DataFrame) -> DataFrame:
    """``(band, cut)``: candidates of a band with step >= cut are not ordinary (Benjamini-Hochberg).

    A step is minus ten times the logarithm of p, rounded down: the step-up's p is never too small.
    """
    table = tested.groupBy("band", "step").agg(F.count("*").alias("c"))
    by = Window.partitionBy("band")
    down = by.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table.withColumn("m", F.sum("c").over(by)).withColumn("rank", F.sum("c").over(down))
    passed = rows.filter(F.pow(F.lit(10.0), -F.col("step") / 10) <= FDR * F.col("rank") / F.col("m"))
    return passed.groupBy("band").agg(F.min("step").alias("cut"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col, n_assign, n_access, n_hex, base, spans`` (arrays of spans).

    A null text counts as empty and has no spans. Rows with a null id and repeated rows stay, and
    repeated candidates count each time in the step-up. Equal p fall in one step and so get one
    verdict. Other columns are not looked at. An empty table gives an empty result. Texts are read whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select("doc_id", base_spans(F.col("t")).alias("base"), matches(F.col("t"), CANDIDATE, F.col("t").rlike(CANDIDATE)).alias("c"))
    fresh = bound(blocked(F.col("base")), lambda base: F.filter("c", lambda x: ~overlaps(base, x["start"], x["end"])))
    # only candidates with a letter and a digit can be secrets: words and numbers are not tested
    mixed = F.filter(fresh, lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
    scan = cut(rows.select("doc_id", "base", F.when(F.size("c") > 0, mixed).alias("c"), F.monotonically_increasing_id().alias("row")))
    one = cut(scan.select("row", F.explode("c").alias("x")).select("row", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.m").alias("token")))
    none = F.lit(None).cast(SPANS).alias("more")
    if one.limit(1).count():
        tested = ordinary(battery(one), letter_counts(docs, text_col))
        tested = tested.filter((F.col("n") * F.log2("k") >= LEAST_BITS) & F.col("body").rlike("[0-9]") & F.col("body").rlike("[A-Za-z]"))
        band = F.concat_ws("/", "encoding", F.floor(F.log2(F.col("n"))).cast("string"))
        tested = tested.withColumn("band", band).withColumn("step", F.least(F.floor(-10 * F.log10("p_ordinary")), F.lit(STEPS)).cast("int"))
        tested = cut(tested.select("row", "start", "end", "band", "step", "p"))
        # one row per band: six encodings and the logarithms of lengths bound this table
        random = tested.join(F.broadcast(thresholds(tested)), "band").filter((F.col("step") >= F.col("cut")) & (F.col("p") >= ALPHA))
        more = random.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("more"))
        out = scan.join(more, "row", "left")
    else:
        out = scan.select("*", none)
    spans = F.array_sort(F.concat("base", F.coalesce(F.col("more"), F.array().cast(SPANS))))
    counts = [count_kind(F.col("base"), i).alias(f"n_{KINDS[i]}") for i in range(3)]
    return out.select(F.col("doc_id").alias(id_col), *counts, "base", spans.alias("spans"))


def digest_columns(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """``base`` as its digest, ``spans`` as text."""
    return rows.withColumn("base_sha256", F.sha2(listed(F.col("base"), kinds), 256)).withColumn("spans", listed(F.col("spans"), kinds)).drop("base")
