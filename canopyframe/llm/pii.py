"""Personal data: patterns, and contexts bootstrapped from what the patterns find. All native.

Patterns find e-mail addresses, IPv4 addresses, payment cards and telephone numbers (the base). Those
are seeds. The two words before a seed are its context; contexts and the identifiers that follow them
form a bipartite graph, whose other identifiers are tokens with a digit or an at sign that no pattern
took. In each round a context is scored by the weight of its identifiers against everything that
follows it anywhere in the corpus, and an identifier by the contexts it stands in. Identifiers that
end above ``CERTAIN`` are marked wherever a scored context or not precedes them.

Scale. One pass over texts leaves spans and mentions without text, written once to the checkpoint
folder. Edges are pre-aggregated to distinct (context, identifier) pairs; a hot context meets AQE's
skew join, and scores are partial sums. What follows a context is counted over all texts: pairs of
words that a bitmap of the contexts (of bounded size) does not hold are dropped where they arise, the others
are counted within each task, then summed, and the sums meet the contexts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.bitmaps import marked
from canopyframe.llm.spans import CHUNK, SPANS, as_spans, blocked, bound, chunks, count_kind, listed, matches, overlaps, piece, replaced
from canopyframe.plans.lineage import cut

KINDS = ["email", "ip", "card", "phone", "context"]
MARKS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[ID]"]
ROUNDS = 3
#: Distinct identifiers that a context must have, and the score from which one is believed.
SUPPORT = 3
CERTAIN = 0.8
MENTIONS = "array<struct<start:int,end:int,context:bigint,item:string,seed:boolean>>"

_LOCAL = "A-Za-z0-9._%+-"
# Possessive groups, which no text can make recurse. A local part starts where its run of characters
# does, or where the last match ended: any later start of the same run meets the same end.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?+[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Tokens with a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: White space, two words and white space at the end: the words are whole.
TWO_WORDS = rf"{SPACE}({WORD}+){SPACE}++({WORD}+){SPACE}++\z"
#: Chunks before a mention in which its context is looked for, one after the other; the last hold any text.
LOOKS = [2 * 8**k for k in range(8)]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of Luhn digits divides by ten."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        double = (n - i) % 2 == 1
        return F.when(double, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _small(part: Column) -> Column:
    """A run of digits that is at most 255."""
    plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(plain) <= 3) & (F.substring(plain, 1, 3).cast("int") <= 255)


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, sorted."""
    email = matches(text, EMAIL, F.contains(text, F.lit("@")))
    ip = matches(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"))
    ip = F.filter(ip, lambda x: F.forall(F.split(x["m"], r"\."), _small))
    card = matches(text, CARD, text.rlike("[0-9](?:[ -]?[0-9]){11}"))
    card = F.filter(card, lambda x: F.length(_digits(x["m"])).between(12, 19) & _luhn(_digits(x["m"])))
    phone = matches(text, PHONE, text.rlike(r"\+[0-9]"))
    phone = F.filter(phone, lambda x: F.length(_digits(x["m"])).between(9, 15))
    return F.array_sort(F.concat(*[as_spans(m, k) for k, m in enumerate((email, ip, card, phone))]))


def _context(parts: Column, start: Column) -> Column:
    """Hash of the two lower-cased words before ``start``, or null if there are not two, each whole.

    They are looked for in the last two chunks before ``start``, then in eight times as many each time, so
    the work follows the words' own length. ``parts`` are the text's chunks.
    """

    def pair(chunks_back: int) -> Column:
        begin = F.greatest((F.floor(start / CHUNK).cast("int") - (chunks_back - 1)) * CHUNK, F.lit(0))
        # a text's first word is whole; so is one after white space, which the pattern asks for
        near = F.concat(F.when(begin == 0, " ").otherwise(""), piece(parts, begin, start))
        found = bound(near, lambda t: F.array(F.regexp_extract(t, TWO_WORDS, 1), F.regexp_extract(t, TWO_WORDS, 2)))
        hashed = bound(found, lambda w: F.when(w[1] != "", F.xxhash64(F.lower(w[0]), F.lower(w[1]))))
        # what the last look held in full need not be looked through again
        return hashed if chunks_back == LOOKS[0] else F.when(F.floor(start / CHUNK) >= chunks_back // 8, hashed)

    return F.coalesce(*[pair(n) for n in LOOKS])


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, key (text digest), base, mentions``; a mention is a span with context and identifier.

    Mentions that no pattern took stay without a context too, since other texts may prove their identifier.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    text = F.col("t")
    rows = rows.select("doc_id", "t", base_spans(text).alias("base"), matches(text, TOKEN, text.rlike("[0-9@]")).alias("tokens"))

    def found(parts: Column) -> Column:
        def mention(x: Column, seed: bool) -> Column:
            item = F.md5(F.lower(piece(parts, x["start"], x["end"])))
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), _context(parts, x["start"]).alias("context"), item.alias("item"), F.lit(seed).alias("seed"))

        free = bound(blocked(F.col("base")), lambda base: F.filter("tokens", lambda x: ~overlaps(base, x["start"], x["end"])))
        return F.concat(F.transform("base", lambda x: mention(x, True)), F.transform(free, lambda x: mention(x, False)))

    mentions = F.when(F.size("base") + F.size("tokens") > 0, bound(chunks(text), found)).otherwise(F.array().cast(MENTIONS))
    return rows.select("doc_id", F.md5("t").alias("key"), "base", F.filter(mentions, lambda m: m["context"].isNotNull() | ~m["seed"]).alias("mentions"))


def context_totals(docs: DataFrame, text_col: str, contexts: DataFrame) -> DataFrame:
    """How often each of the distinct ``contexts`` is followed by any word, over all texts.

    A bitmap of the contexts drops other pairs of words where they arise; an exact join drops what it lets through.
    """
    words = docs.select(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), F.lit(0)).alias("w")).filter(F.size("w") > 2)
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 2), F.slice("w", F.lit(2), F.size("w") - 2), lambda a, b: F.xxhash64(a, b))
    met, may = marked(words.select(F.explode(pairs).alias("context")), "context", contexts.select(F.col("context").alias("digest")))
    return met.filter(may).groupBy("context").agg(F.count("*").alias("total")).join(contexts, "context", "left_semi")


def learn(docs: DataFrame, scanned: DataFrame, text_col: str, rounds: int = ROUNDS, support: int = SUPPORT, certain: float = CERTAIN) -> DataFrame:
    """``(item)``: identifiers that no base pattern takes and whose contexts vouch for them."""
    seen = scanned.select(F.explode("mentions").alias("m")).filter("m.context IS NOT NULL").select("m.context", "m.item", "m.seed")
    edges = seen.groupBy("context", "item").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    wide = edges.groupBy("context").agg(F.count("*").alias("items"), F.max("seed").alias("seeded")).filter(F.col("items") >= support)
    # contexts with seeds alone find nothing, and those without can only be reached through other contexts' finds
    edges = cut(edges.join(wide.select("context"), "context", "left_semi"))
    if not edges.filter("NOT seed").limit(1).count():
        return edges.filter("seed AND NOT seed").select("item")
    totals = cut(context_totals(docs, text_col, cut(edges.select("context").distinct())))
    items = edges.groupBy("item").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(rounds):
        sums = edges.join(items, "item").groupBy("context").agg(F.sum(F.col("n") * F.col("score")).alias("weight"), F.sum("score").alias("backing"))
        # a text counts each follower once, so weight never exceeds total
        scored = sums.filter(F.col("backing") >= support).join(totals, "context").select("context", (F.col("weight") / (F.greatest("total", "weight") + 1)).alias("trust"))
        doubt = F.sum(F.log1p(-F.least(F.coalesce("trust", F.lit(0.0)), F.lit(0.999999))))
        items = edges.join(scored, "context", "left").groupBy("item").agg(F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(doubt)).alias("score"), F.max("seed").alias("seed"))
        items = cut(items)
    return items.filter((F.col("score") >= certain) & ~F.col("seed")).select("item")


def discovered(scanned: DataFrame, items: DataFrame) -> DataFrame:
    """``(key, more)``: for each text with discovered identifiers their spans."""
    free = scanned.select("key", F.explode("mentions").alias("m")).filter("NOT m.seed").select("key", "m.item", "m.start", "m.end").distinct()
    span = F.struct("start", F.lit(4).alias("kind"), "end")
    return free.join(items, "item", "left_semi").groupBy("key").agg(F.collect_set(span).alias("more"))


def _all_spans() -> Column:
    return F.array_sort(F.concat("base", F.coalesce(F.col("more"), F.array().cast(SPANS))))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col, n_email, n_ip, n_card, n_phone, base, spans`` (arrays of spans).

    A null text counts as empty and has no spans. Rows with a null id and repeated rows stay; equal
    texts get equal spans. Contexts of equal score are treated alike. Other columns are not looked at.
    An empty table gives an empty result. Texts are read whole.
    """
    scanned = cut(scan(docs, id_col, text_col))
    more = discovered(scanned, learn(docs, scanned, text_col))
    # only texts with an identifier that no pattern took can gain spans; the others need no shuffle
    free = F.exists("mentions", lambda m: ~m["seed"])
    gain = scanned.filter(free).drop("mentions").join(more, "key", "left")
    out = scanned.filter(~free).drop("mentions").withColumn("more", F.lit(None).cast(SPANS)).unionByName(gain)
    counts = [count_kind(F.col("base"), i).alias(f"n_{KINDS[i]}") for i in range(4)]
    return out.select(F.col("doc_id").alias(id_col), *counts, "base", _all_spans().alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with its own columns; personal data in the text is replaced by its kind's mark.

    ``length_col``, if the table has it, is set to the new length. A null text stays null.
    """
    scanned = cut(scan(docs, id_col, text_col).select("key", "base", "mentions"))
    more = cut(discovered(scanned, learn(docs, scanned, text_col)))
    # the document's columns ride in a struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = F.col("row")[text_col]
    if more.limit(1).count():
        rows = rows.withColumn("key", F.md5(F.coalesce(own, F.lit("")))).join(more, "key", "left")
    else:
        rows = rows.withColumn("more", F.lit(None).cast(SPANS))
    spans = F.array_sort(F.concat(base_spans(F.coalesce(own, F.lit(""))), F.coalesce("more", F.array().cast(SPANS))))
    rows = rows.select("row", spans.alias("spans")).withColumn("clean", replaced(own, F.col("spans"), MARKS))
    new = {text_col: F.col("clean")}
    if length_col in docs.columns:
        new[length_col] = F.when(F.size("spans") > 0, F.length("clean")).otherwise(F.col("row")[length_col]).cast(docs.schema[length_col].dataType)
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def digest_columns(rows: DataFrame) -> DataFrame:
    """``base`` as its digest, ``spans`` as text."""
    return rows.withColumn("base_sha256", F.sha2(listed(F.col("base"), KINDS), 256)).withColumn("spans", listed(F.col("spans"), KINDS)).drop("base")
