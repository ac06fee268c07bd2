import hashlib
import re

from canopyframe.llm import warc as W


def parse(record):
    """Header fields and block of one WARC record; fails where it is not one."""
    head, rest = record.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    assert version == "WARC/1.1"
    fields = dict(x.split(": ", 1) for x in lines)
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and re.fullmatch("<[a-z]+:[^ >]+>", fields["WARC-Record-ID"])
    n = int(fields["Content-Length"])
    assert rest[n:] == b"\r\n\r\n"
    return fields, rest[:n]


def test_round_trip(spark):
    long, short = "é" * 80, "s" * 99
    rows = [(4, "http://a\r\nX: y", long), (2, "http://b", long), (9, None, long), (1, "http://c", short), (3, "http://d", short), (5, "http://e", None), (6, "u", ""), (2, "http://b", long), (7, "v", "x" * 300_000), (None, "n", long)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, header string").repartition(3)
    got = W.archive_and_read(df).collect()
    assert len(got) == len(rows)
    for r in got:
        digest = hashlib.sha256(bytes(r.payload)).hexdigest()
        assert r.payload_digest == digest
        fields, block = parse(bytes(r.record))
        assert fields["WARC-Type"] == r.record_type and fields["WARC-Payload-Digest"] == f"sha256:{digest}"
        assert {"WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Type", "Content-Length"} <= set(fields)
        head, body = block.split(b"\r\n\r\n", 1)
        assert head.startswith(b"HTTP/1.1 200 OK\r\n") and b"Content-Length: %d" % len(r.payload) in head
        assert body == (b"" if r.record_type == "revisit" else bytes(r.payload)) and r.content_length == len(block)
    ids = {parse(bytes(r.record))[0]["WARC-Record-ID"]: r for r in got}
    assert len(ids) == len(got)
    for r in got:
        to = parse(bytes(r.record))[0].get("WARC-Refers-To")
        assert (to is None) == (r.refers_to is None) and (to is None or (ids[to].page_id == r.refers_to and ids[to].payload_digest == r.payload_digest and ids[to].record_type == "response"))
    facts = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert facts == [(0, "revisit", 2), (1, "response", None), (2, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 2), (5, "response", None), (6, "response", None), (7, "response", None), (9, "revisit", 2)]
    texts = {r.page_id: bytes(r.payload).decode() for r in got}
    assert texts[4] == texts[9] == long and texts[5] == "" and texts[7] == "x" * 300_000
    assert {r.url for r in got if r.page_id == 4} == {"http://a%0D%0AX: y"}
    assert parse(bytes(W.archive_and_read(df, date="2020-01-02T03:04:05Z").first().record))[0]["WARC-Date"] == "2020-01-02T03:04:05Z"
    assert W.archive_and_read(df.limit(0)).count() == 0


def test_a_changed_payload_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    headers, payloads = W.records(df)
    headers.write.parquet(f"{tmp_path}/headers")
    payloads.selectExpr("payload_digest", "encode('other', 'UTF-8') AS payload").write.parquet(f"{tmp_path}/payloads")
    try:
        W.read_archive(spark, str(tmp_path)).collect()
    except Exception as e:
        assert "not as digested" in str(e)
    else:
        raise AssertionError("the change was not noticed")


def test_shared_payloads_in_every_number(spark):
    """One payload of most pages, many of two pages each, and unshared ones; every payload is stored once."""
    rows = [(i, "u", "hot " * 50 if i % 3 else f"pair {i // 6} " * 30 if i % 2 else f"alone {i} " * 30) for i in range(1200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    headers, payloads = W.records(df)
    assert payloads.count() == payloads.select("payload_digest").distinct().count() == len({h for _, _, h in rows})
    got = {r.page_id: r for r in W.archive_and_read(df).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    assert all(bytes(got[i].payload).decode() == h and got[i].refers_to == (None if first[h] == i else first[h]) for i, _, h in rows)


def test_ids_of_any_type_come_back(spark):
    shared = "x" * 200
    for kind, ids in (("string", ["b", "a>b\r\nX: y", "é ü", None]), ("decimal(20,2)", [2, 1, 3, None]), ("binary", [b"b", b"a", b"c", None])):
        rows = [(i, "u", shared) for i in ids] + [(ids[0], "u", "short")]
        df = spark.createDataFrame([(r[0] if not isinstance(r[0], int) else __import__("decimal").Decimal(r[0]), *r[1:]) for r in rows], f"page_id {kind}, url string, html string")
        got = W.archive_and_read(df)
        assert got.schema["page_id"].dataType == df.schema["page_id"].dataType == got.schema["refers_to"].dataType
        first = df.filter("page_id IS NOT NULL").agg({"page_id": "min"}).first()[0]
        facts = {(str(r.page_id), r.record_type, str(r.refers_to)) for r in got.filter("length(payload) = 200").collect()}
        assert facts == {(str(i), "response" if i == first else "revisit", "None" if i == first else str(first)) for i in [r.page_id for r in df.filter("length(html) = 200").collect()]}
        # a header is lines of name and value, whatever the id holds
        assert all(": " in line for r in got.collect() for line in bytes(r.header).decode().strip().split("\r\n")[1:])
