import hashlib
import random

from canopyframe.llm import decontaminate as D


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    keep = "".join(c if c.isascii() and (c.isdigit() or "a" <= c <= "z") or ord(c) > 127 else " " for c in low)
    return [w for w in keep.split(" ") if w]


def brute(docs, items):
    windows = []
    for i, t in items:
        w = plain_words(t)
        n = min(10, len(w))
        windows += [(i, w[k : k + n]) for k in range(len(w) - n + 1) if n]
    out = []
    for d, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit.update(range(k, k + len(g)))
                    found.add(i)
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def cases():
    rng = random.Random(5)
    vocabulary = ["alpha", "Béta", "c3", "delta", "E", "été"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25)))) for i in range(2, 12)] + [(0, None), (1, ""), (30, "rare words"), (31, "Rare, words!"), (None, "nameless thing here")]
    docs = [(0, None), (1, ""), (2, "..."), (3, "so RARE--words and rare words"), (4, "a nameless THING here now"), (5, "x " * 5000 + "rare words")]
    for k in range(6, 40):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120)))
        if k % 3:
            text = f"{text}, {items[k % 10][1]}. {text}"
        docs.append((k, text))
    return docs + [docs[3]], items + [items[12]]


def test_matches_brute_force_in_one_block_and_in_many(spark):
    docs, items = cases()
    df = spark.createDataFrame([(d, t, "z", True) for d, t in docs], "doc_id long, text string, n_words string, items boolean").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items))
    for block in (4_000_000, 300, 60):
        got = D.flag_contamination(df, bench, block_bytes=block)
        rows = got.select("doc_id", "n_words", "n_hit", "n_items", D.digest(got["items"]), "contaminated").collect()
        assert sorted(map(tuple, rows)) == want
    assert D.flag_contamination(df.limit(0), bench).count() == 0
    assert not [r for r in D.flag_contamination(df, bench.limit(0)).collect() if r.contaminated]


def test_removes_documents_or_spans(spark):
    docs = spark.createDataFrame([(1, "Éa one TWO three. tail", "k"), (2, "clean", "k"), (3, None, None), (4, "one two three one two three", "k")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(9, "one two three")], "item_id long, text string")
    assert sorted(r.doc_id for r in D.decontaminate(docs, bench).collect()) == [2, 3]
    spans = D.decontaminate(docs, bench, "spans")
    assert spans.columns == docs.columns
    assert {r.doc_id: r.text for r in spans.collect()} == {1: "Éa . tail", 2: "clean", 3: None, 4: ""}


def test_blocks_are_scanned_one_after_the_other(spark, monkeypatch):
    """With 50 blocks and more, no index is made before the one before it has gone."""
    items = [(f"item {i}", f"word{i} of the rare passage number {i} here") for i in range(200)]
    docs = spark.createDataFrame([(str(i), f"so {t}. and {items[i - 1][1]}") for i, (_, t) in enumerate(items)], "doc_id string, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id string, text string")
    live, most, made = [], [], []
    real = spark.sparkContext.broadcast

    def broadcast(index):
        out = real(index)
        live.append(out)
        most.append(len(live))
        made.append(len(index.number))
        gone = out.destroy
        monkeypatch.setattr(out, "destroy", lambda *a: (live.remove(out), gone(*a))[1])
        return out

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    got = D.flag_contamination(docs, bench, block_bytes=300)
    assert max(most) == 1 and len(made) > 50 and max(made) < 100
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == 200 and rows["5"].items == ["item 4", "item 5"] and rows["0"].items == ["item 0", "item 199"]
    assert all(r.n_hit == 16 and r.n_items == 2 for r in rows.values())


def test_string_ids_long_items_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    bench = spark.createDataFrame([("b", long), ("a", "w7 w8")], "item_id string, text string")
    for block in (4_000_000, 2000):
        assert {w for _, t in [(r.i, r.t) for r in D.item_parts(bench, "item_id", "text", block, 10).collect() if r.i == "b"] for w in t.split()} == set(long.split())
        docs = spark.createDataFrame([("x", " ".join(f"W{i}" for i in range(240, 262)), 1, 2, "r"), ("y", "w7, w8 w9", 1, 2, "r"), ("z", "w1 w2 w3 w4", 1, 2, "r")], "doc_id string, text string, __scan int, hits int, own string")
        got = {r.doc_id: (r.n_hit, r.items) for r in D.flag_contamination(docs, bench, block_bytes=block).collect()}
        assert got == {"x": (22, ["b"]), "y": (2, ["a"]), "z": (0, [])}
        for mode, left in (("drop", ["z"]), ("spans", ["x", "y", "z"])):
            out = D.decontaminate(docs, bench, mode, block_bytes=block)
            assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == left
        assert D.decontaminate(docs.limit(0), bench, block_bytes=block).count() == 0
        assert D.decontaminate(docs, bench.limit(0), "spans", block_bytes=block).count() == 3
