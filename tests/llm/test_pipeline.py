"""The pipeline's stages, one after another, against plain versions of each."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import brute
from tests.llm.test_pii import plain as plain_spans
from tests.llm.test_shingles import plain_groups

MARKS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"]


def tables():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeiounrstlm") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    items = [(i, prose(20)) for i in range(4)]
    docs, bad = [], set()
    for i in range(70):
        kind = i % 7
        text = prose(rng.randint(60, 200))
        if kind == 1:
            text, _ = " ".join(w.upper() + "!!" for w in text.split()), bad.add(i)
        elif kind == 2:
            text = f"{text} {items[i % 4][1]} {prose(30)}"
        elif kind == 3:
            text = f"{text} write to {word()}@mail.example.org or +1 (555) 555-{1000 + i} {prose(5)}"
        elif kind == 4:
            text = docs[i - 4][1] if i % 2 else docs[i - 4][1] + " " + word()
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
    docs += [(500, None, None, None, None), (501, "", "en", "s", 0)]
    labels = [(i, int(i not in bad), 0) for i in range(70)]
    return docs, labels, items


def redacted(text):
    if not text:
        return text
    out, at = "", 0
    for a, k, b in plain_spans(text)[2]:
        if a >= at:
            out += text[at:a] + MARKS[k]
        at = max(at, b)
    return out + text[at:]


def test_stages_against_plain_versions(spark, tmp_path):
    docs, labels, items = tables()
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = now.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        assert k == 4 or out.columns == columns
        out.write.parquet(f"{folder}/out{k}")
        now = spark.read.parquet(f"{folder}/out{k}")
        seen.append([r.asDict() for r in now.collect()])

    bad = {i for i, good, _ in labels if not good}
    kept = {r["doc_id"]: r["text"] for r in seen[0]}
    assert set(range(70)) - bad == set(kept) & set(range(70))

    ids = sorted(kept)
    groups = plain_groups([kept[i] for i in ids])
    first = {ids[g] for g in groups}
    assert {r["doc_id"] for r in seen[1]} == first and len(seen[1]) == len(first)

    hit = {d for d, *_, c in brute([(i, kept[i]) for i in first], items) if c}
    assert hit and {r["doc_id"] for r in seen[2]} == first - hit

    assert {r["doc_id"]: r["text"] for r in seen[3]} == {i: redacted(kept[i]) for i in first - hit}
    assert all(r["n_chars"] == len(r["text"]) for r in seen[3] if r["text"])

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total, fills = {}, {}
    for r in seen[4]:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        fills[r["sequence_id"]] = fills.get(r["sequence_id"], 0) + r["length"]
    assert total == {r["doc_id"]: len(model.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in seen[3]}
    assert max(fills.values()) <= 2048

    again = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()}
    assert again == {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in seen[4]}
