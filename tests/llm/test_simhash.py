import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from canopyframe.llm import simhash as S


def plain_fingerprint(text):
    if text is None:
        return 0
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(fps))]


def test_covering_property():
    masks = [m & (1 << 64) - 1 for m in S.covering_masks()]
    rng = random.Random(1)
    for _ in range(3000):
        x = sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4)))
        assert any(x & m == 0 for m in masks)
    assert all(28 <= m.bit_count() <= 36 for m in masks)


def test_matches_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    texts = [None, "", "  \n", "one", "Two words", "A b c\x1cd e f", "x " * 9000]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            other = list(base)
            other[rng.randrange(len(other))] = "changed"
            texts.append("\n".join(other))
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(5)
    got = {r.doc_id: r for r in S.simhash_near_duplicates(df).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i].component_id for i in range(len(texts))] == plain_components(fps)


def test_forest_midpoints_and_streaming_agree(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(30):
            x = b
            for i in rng.choice(64, rng.integers(1, 8), replace=False).tolist():
                x ^= 1 << i
            fps.add(x)
    fps = sorted(fps)
    want = plain_components(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "doc_id long, fp long")
    for bucket in (4096, 3):  # the small bound sends buckets the second way
        edges = S.link_fingerprints(df.select("fp"), bucket=bucket)
        parts = S.connected_components(edges)
        named = df.join(parts, F.col("fp") == F.col("node"), "left").select("doc_id", F.coalesce("component", "fp").alias("c")).collect()
        groups = {}
        for r in named:
            groups.setdefault(r.c, []).append(r.doc_id)
        first = {d: min(g) for g in groups.values() for d in g}
        assert [first[i] for i in range(len(fps))] == want


def test_drop_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (9, "another text altogether here now", "c"), (None, None, "d"), (None, "", None), (3, "same id but other words here", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:4]) for r in kept.collect()) == [(-1, ""), (3, "same"), (3, "w0 w"), (9, "anot")]
    empty = df.limit(0)
    assert S.drop_near_duplicates(empty).count() == 0 and S.simhash_near_duplicates(empty).count() == 0
