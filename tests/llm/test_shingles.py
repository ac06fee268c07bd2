import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from canopyframe.llm import shingles as G
from canopyframe.llm import simhash as S
from tests.llm.test_simhash import plain_fingerprint


def plain_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(texts):
    """First index of each text's group: fingerprints within four bits, or similarity of 0.8 or more."""
    sets, prints = [plain_set(t) for t in texts], [plain_fingerprint(t) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= 4 or (common and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common)):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def corpus():
    """Groups of copies with few and many edits, a passage that many texts share, short and odd texts."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("aeiounrstlm") for _ in range(rng.randint(3, 8)))
    texts = [None, "", " \n ", "one", "One", "one two three", "one two four", "a b c d e", "a b c d e f"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(30, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(10)] + passage + [word() for _ in range(rng.randint(2, 25))]) for _ in range(60)]
    original = [word() for _ in range(90)]
    for _ in range(80):  # one large group: each copy is close to the original, not to the others
        copy = list(original)
        copy[rng.randrange(90)] = word()
        texts.append(" ".join(copy))
    texts.append(" ".join(original))
    return texts


def test_groups_equal_brute_force_in_buckets_of_any_size(spark):
    texts = corpus()
    want = plain_groups(texts)
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, sid string, row int, c int").repartition(4)
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = {r.doc_id for r in kept.collect()}
    assert got == {i for i, g in enumerate(want) if i == g}
    assert len(set(want)) < len(texts) - 100
    # the fingerprints alone leave many of these copies
    alone = {r.component_id for r in S.simhash_near_duplicates(df).collect()}
    assert len(alone) > len(got) + 20


def test_large_buckets_take_another_way_to_the_same_groups(spark, monkeypatch):
    texts = [t for t in corpus() if t and len(t.split()) > 4]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("sid", G.text_key(F.col("text")))
    groups = df.select("sid", F.col("i").alias("c"))
    name = {}
    for bucket in (4096, 17):
        rows = G.linked_groups(df.select("sid", "text"), groups, bucket).collect()
        name[bucket] = {r.c: r.group for r in rows}
    assert name[17] == name[4096] and len(name[17]) > 100


def templates(n, own):
    """Pages of one template of 280 words with ``own`` words each: alike in most words, but no two of them are 0.8 alike."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeiounrstlm") for _ in range(7))
    base = " ".join(word() for _ in range(280))
    return [base + " " + " ".join(word() for _ in range(own)) for _ in range(n)]


def test_template_pages_in_one_bucket_take_one_pass(spark, monkeypatch):
    """Every pair of blocks is compared, links across blocks are found, and components are joined as often for any size."""
    rounds = []
    own = G.connected_components
    monkeypatch.setattr(G, "connected_components", lambda *a: rounds.append(1) or own(*a))
    name = {}
    for n in (60, 300):
        texts = templates(n, 60)
        texts += [texts[3].rsplit(" ", 2)[0], texts[n // 2].rsplit(" ", 3)[0], texts[n - 1] + " tail"]
        df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("sid", G.text_key(F.col("text")))
        rounds.clear()
        rows = G.linked_groups(df.select("sid", "text"), df.select("sid", F.col("i").alias("c")), 16).collect()
        groups = {r.c: r.group for r in rows}
        assert groups == {3: 3, n: 3, n // 2: n // 2, n + 1: n // 2, n - 1: n - 1, n + 2: n - 1}
        name[n] = len(rounds)
    assert name[60] == name[300] <= 4


def test_block_pairs_hold_every_pair_once_within_their_bounds(spark):
    rng = random.Random(2)
    rows = [(k, f"s{i:03d}".encode(), i, rng.choice([10, 11, 50, 1000])) for k in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "key long, sid binary, c long, size int")
    out = G.in_block_pairs(df, 10).collect()
    parts = {}
    for r in out:
        parts.setdefault(r.key, []).append((r.sid, r.side))
    met = {}
    for own in parts.values():
        assert len(own) <= 10 and {s for _, s in own} in ({0}, {1, 2})
        for i, (a, x) in enumerate(own):
            for b, y in own[:i]:
                if x == 0 or x != y:
                    key = tuple(sorted((a, b)))
                    met[key] = met.get(key, 0) + 1
    size = {r[1]: [q[3] for q in rows if q[1] == r[1]] for r in rows}
    for k in (0, 1):
        for i in range(40):
            for j in range(i):
                a, b = size[rows[i][1]][k], size[rows[j][1]][k]
                if min(a, b) >= 0.8 * max(a, b):
                    assert met[rows[j][1], rows[i][1]] >= 1
    assert max(met.values()) <= 2  # once in each of the two buckets


def test_kernel_links_groups_of_each_bucket_across_batches():
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k in range(6):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        own = [np.unique(np.concatenate([base[i % 3 * 2 :], rng.integers(0, 2**63, 3 * (i % 4)).astype(np.uint64)])) for i in range(9)]
        group = {i: k * 100 + i // 2 for i in range(9)}
        rows += [(k, group[i], (G.minima(h) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes(), h.tobytes()) for i, h in enumerate(own)]
        for i in range(9):
            for j in range(i):
                common = len(np.intersect1d(own[i], own[j]))
                if common >= 0.8 * (len(own[i]) + len(own[j]) - common):
                    want.setdefault(group[i], set()).add(group[j])
    names = ["key", "c", "sketch", "hashes"]
    whole = lambda a, b: {n: pa.array([r[k] for r in rows[a:b]], pa.int64() if k < 2 else pa.binary()) for k, n in enumerate(names)}
    cut = lambda a, b: pa.RecordBatch.from_pydict(whole(a, b) | {"side": pa.array([0] * len(rows[a:b]), pa.int32())})

    def joined(pairs):
        label = {r[1]: r[1] for r in rows}
        for a, b in pairs:
            x, y = label[a], label[b]
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
        return label

    for step in (54, 7, 1):
        out = [(x["ca"], x["cb"]) for b in G._link_buckets(iter([cut(i, i + step) for i in range(0, 54, step)])) for x in b.to_pylist()]
        assert joined(out) == joined((a, b) for a, bs in want.items() for b in bs) and len(out) < 54 and all(a // 100 == b // 100 for a, b in out)
    assert sum(b.num_rows for b in G._link_buckets(iter([]))) == 0
