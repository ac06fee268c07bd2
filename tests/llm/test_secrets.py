import hashlib
import random
import re

from canopyframe.llm import secrets as S

KINDS = [
    ("assign", re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def plain(text):
    text = text or ""
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text) if ok(m)]
    found.sort()
    base = ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in found)
    return [sum(k == i for _, k, _ in found) for i in range(3)], hashlib.sha256(base.encode()).hexdigest(), base


def texts():
    rng = random.Random(8)
    out = [
        None,
        "",
        "secret=token = abcdefgh",
        "PassWord: 'hunter22' api_key=\"x\" APIKEY = abc.def=/+_-",
        "token:token:token:abcdef",
        "AKIAAKIA" + "B" * 12 + " xAKIA" + "9" * 15 + " AKIA" + "Z" * 16,
        "é" * 50 + " secret = zzzzzz " + "a" * 23 + " " + "0f" * 12 + "g" + "ab" * 30,
        "password==abcdef token\n=abcdef ſecret=abcdef",
        "日本 " + "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        "a" * 200_000,
        "token=" + "ab" * 50_000,
        "thisisaverylongwordwithoutanymeaning thatgoesonandonandonandonandon",
        "x=" + "1" * 64 + " " + "ab12" * 20,
        "key " + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) + "==",
    ]
    bits = ["secret", "token", "=", ":", " ", "'", '"', "abc", "AKIA", "ABCDEFGHIJKLMNOPQ", "0123456789abcdef", "\n", "é", "api_key", "_"]
    return out + ["".join(rng.choice(bits) for _ in range(60)) for _ in range(60)]


def test_base_equals_brute_force(spark):
    rows = [(i, t, "z") for i, t in enumerate(texts())] + [(3, texts()[3], "z"), (None, "secret=abcdef", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string").repartition(3)
    got = S.digest_columns(S.find_secrets(df), S.KINDS).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            counts, digest, base = plain(texts()[r.doc_id])
            assert [r.n_assign, r.n_access, r.n_hex] == counts and r.base_sha256 == digest, r.doc_id
            assert set(base.split(",")) - {""} <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in got}
    assert "random" not in spans[11] + spans[12] and spans[13].startswith("random:4:")
    assert S.find_secrets(df.limit(0)).count() == 0


def keys(rng):
    """(kind, random key): the kinds of keys that no base pattern takes."""
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    h = draw(dig + "abcdef", 32)
    return [
        ("prefixed", "ghp_" + draw(low + up + dig, 36)),
        ("two prefixes", "sk_live_" + draw(low + up + dig, 32)),
        ("uuid", f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"),
        ("base32", draw(up + "234567", 32)),
        ("base64", draw(low + up + dig + "+/", 40)),
        ("base64url", draw(low + up + dig + "-_", 43)),
        ("slack", f"xoxb-{draw(dig, 12)}-{draw(low + up + dig, 28)}"),
        ("lower", draw(low + dig, 40)),
        ("HEX", draw(dig + "ABCDEF", 32)),
    ]


def ordinary_tokens(rng, words):
    w = lambda: rng.choice(words)
    return [
        "get" + "".join(w().capitalize() for _ in range(5)) + str(rng.randrange(10)),
        f"usr/share/{w()}/{w()}{rng.randrange(20)}/{w()}/{w()}",
        f"2024-0{rng.randrange(1, 9)}-{rng.randrange(10, 29)}-how-to-{w()}-{w()}-on-{w()}",
        f"{w()}_{w()}_{w()}_{w()}_{rng.randrange(100)}_{w()}".upper(),
        f"{w()}{w()}{w()}{w()}{w()}{rng.randrange(1000)}",
        f"{w().capitalize()}{w().capitalize()}{w().capitalize()}{w().capitalize()}V{rng.randrange(9)}x64Setup",
    ]


def test_recall_and_precision_of_added_spans(spark):
    """Of 100 random keys of each of nine kinds at least 0.9 are found, and of what is found at least 0.95 are keys."""
    rng = random.Random(21)
    words = ["river", "stone", "account", "window", "server", "reader", "garden", "market", "number", "letter", "station", "history", "picture", "question", "children", "mountain", "problem", "music", "paper", "other"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, where, kind_of = [], {}, {}
    for i in range(100):
        for kind, key in keys(rng):
            text = f"{prose(6)} é {key} {prose(4)}"
            where[len(rows)], kind_of[len(rows)] = (text.index(key), text.index(key) + len(key)), kind
            rows.append((len(rows), text))
        for token in ordinary_tokens(rng, words) * 2:
            rows.append((len(rows), f"{prose(5)} {token} {prose(5)}"))
    found = {}
    for r in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found |= {(r.doc_id, x.start, x.end): 1 for x in r.spans if x.kind == 3}
    right = {d for d, s, e in found if d in where and s <= where[d][0] + 5 and e >= where[d][1] - 2}
    by_kind = {k: sum(kind_of[d] == k for d in right) for k in dict.fromkeys(kind_of.values())}
    assert min(by_kind.values()) >= 90 and len(by_kind) == 9 and len(right) >= 0.95 * len(found), by_kind


def test_short_and_ordinary_strings_are_no_secrets(spark):
    rows = [(0, "usr/share/doc/python3/examples/index2"), (1, "theSmallRiverRunsPastOld13Stones"), (2, "id-2024-11-28-23-59-59-000001"), (3, "abcdefghijklmnopqrst1"), (4, "-" * 40 + " " + "_" * 20)]
    got = S.find_secrets(spark.createDataFrame(rows + [(9, "blue sky of the river stone " * 50)], "doc_id long, text string")).collect()
    assert not [r.doc_id for r in got if any(x.kind == 3 for x in r.spans)]


def test_letter_counts_equal_brute_force(spark):
    made = [t for t in texts() if t] + ["ÄÖ日本 Zz9"]
    got = S.letter_counts(spark.createDataFrame(list(enumerate(made)) + [(99, None)], "doc_id long, text string"), "text")
    low = "".join(made).lower()
    assert got == {c: low.count(c) for c in got} and len(got) == 36


def test_battery_tells_random_from_structured(spark):
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    rows = [(True, "".join(rng.choice(alphabet) for _ in range(40))) for _ in range(300)]
    rows += [(True, "".join(rng.choice("0123456789abcdef") for _ in range(64))) for _ in range(300)]
    rows += [(False, "path/to/some/file_name/in/a/directory/tree" + str(i)) for i in range(100)]
    rows += [(False, "".join(rng.choice("aeiou") + rng.choice("0123") for _ in range(30))) for i in range(100)]
    rows += [(False, "0123456789abcdef" * 4)]
    df = spark.createDataFrame(rows, "random boolean, token string")
    tested = S.battery(df).collect()
    true = [r.p for r in tested if r.random]
    # p is about uniform for random strings and small for others
    assert 0.2 < sum(p < 0.5 for p in true) / len(true) < 0.75
    assert sum(p < 0.01 for p in true) / len(true) < 0.05
    # what alternates or repeats is told by randomness, what is written in words by its letters
    assert sum(r.p < 0.001 for r in tested if not r.random and "path" not in r.token) == 101
    english = dict(zip("etaoinshrdlcumwfgypbvkjxqz", [127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 2, 2, 1, 1]))
    scored = S.ordinary(S.battery(df), english).collect()
    assert all(r.p_ordinary > 0.05 for r in scored if "path" in r.token)
    assert sum(r.p_ordinary < 0.05 for r in scored if r.random) > 500


def test_step_up_equals_a_sort(spark):
    rng = random.Random(6)
    steps = [min(400, int(rng.expovariate(0.1))) for _ in range(500)]
    df = spark.createDataFrame([("b", s) for s in steps], "band string, step int")
    cut = [r.cut for r in S.thresholds(df).collect()]
    want = [s for s in set(steps) if 10 ** (-s / 10) <= S.FDR * sum(x >= s for x in steps) / len(steps)]
    assert cut == ([min(want)] if want else [])


def test_extra_columns_of_the_operators_names_and_ids_of_any_type(spark):
    rows = [("a", "x " * 3 + "AKIA" + "B" * 16, 1, "t", 2), (None, None, 3, "t", 4), ("a", "", 5, "t", 6)]
    df = spark.createDataFrame(rows, "doc_id string, text string, base int, t string, row int")
    got = S.find_secrets(df).collect()
    assert sorted((str(r.doc_id), r.n_access, len(r.spans)) for r in got) == [("None", 0, 0), ("a", 0, 0), ("a", 1, 1)]
