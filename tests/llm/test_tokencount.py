import random

from canopyframe.llm import tokencount as T


def greedy(pieces, word):
    have, n, in_bytes = set(pieces), 0, 0
    while word:
        for k in range(len(word), 0, -1):
            if word[:k] in have:
                n, word = n + 1, word[k:]
                break
        else:
            size = len(word[0].encode())
            n, in_bytes, word = n + size, in_bytes + size, word[1:]
    return n, in_bytes


def test_automaton_equals_greedy_matching():
    rng = random.Random(9)
    for _ in range(200):
        pieces = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 25))]
        machine = T.Automaton(pieces)
        for _ in range(40):
            word = "".join(rng.choice("abcéx日") for _ in range(rng.randint(0, 15)))
            assert machine.length(word) == greedy(pieces, word), (pieces, word)


def test_documents(spark):
    pieces = T.load_pieces()
    texts = [None, "", "  \n", "Hello world", "internationalisation der Übergröße 日本語 \x1c🙂", "word " * 9000, "x" * 50_000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "a", "z"), (3, "Hello world", "z")], "doc_id long, text string, n_tokens string").repartition(2)
    got = T.token_counts(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None and r.doc_id < 6:
            words = [w for w in (texts[r.doc_id] or "").replace("\n", " ").split(" ") if w]
            some = [greedy(pieces, "▁" + w) for w in words[:40]]
            if len(words) <= 40:
                assert tuple(r)[1:] == (len(words), sum(t for t, _ in some), sum(b for _, b in some))
            else:
                assert r.n_tokens == len(words) * some[0][0]
    assert T.token_counts(df.limit(0)).count() == 0
