from collections import Counter

import duckdb

from canopyframe.llm import rules as R


def plain(text):
    text = text or ""
    words, now = [], ""
    for c in text + " ":
        if c == " " or "\t" <= c <= "\r":
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if any(not (c == " " or "\t" <= c <= "\r") for c in x)]
    n = len(words)
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


TEXTS = [
    None,
    "",
    " \t\n",
    "one two",
    "a\x1cb\x85c\xa0d " * 30,
    "same line here now\n" * 40,
    " ".join(f"w{i}" for i in range(80)),
    " ".join(f"WORD{i}!!" for i in range(80)),
    " ".join(f"x{i} |" for i in range(80)),
    "é日 " + " ".join(f"ü{i}\n" for i in range(60)),
    " ".join(f"{i}{i}" for i in range(90)),
    " ".join(f"w{i % 70} the" for i in range(100)),
    "\n".join(["dup line of text"] * 3 + [f"line {i} of text" for i in range(30)]),
    "long " * 20000,
]


def test_base_counts_and_sql(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], "z"), (None, "x", None)], "doc_id long, text string, kept string").repartition(3)
    rows = R.quality_rules(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is not None:
            assert tuple(r)[1:7] == plain(TEXTS[r.doc_id])
    con = duckdb.connect()
    documents = df.filter("doc_id IS NOT NULL").distinct().toArrow()  # noqa: F841
    con.register("documents", documents)
    want = sorted(con.execute(R.SQL).fetchall())
    got = sorted({tuple(r)[:8] for r in rows if r.doc_id is not None})
    assert got == want
    assert R.quality_rules(df.limit(0)).count() == 0


def test_order_changes_work_not_verdicts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    both = [df.select("doc_id", R.verdict_column(df["text"], order).alias("v")).select("doc_id", "v.kept").collect() for order in (list(R.RULES), list(R.RULES)[::-1])]
    assert both[0] == both[1]
    assert R.cascade_order({r: (1.0, 0.0) for r in R.RULES} | {"top_word": (2.0, 0.9), "digits": (1.0, 0.5)})[:2] == ["digits", "top_word"]
    measured = R.measure(df)
    assert set(measured) == set(R.RULES) and measured["symbols"][1] > 0
