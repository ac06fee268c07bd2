"""Content-addressed web archive.

A page becomes a WARC/1.1 record: a response whose block is an HTTP head and the payload, or a revisit
whose block is the HTTP head alone. Payload bytes are stored once, under their SHA-256; the exact bytes
of each record's header and HTTP head are stored apart, with that digest. Reading joins the two
tables, checks each payload against its digest and gives back the records' bytes.

Scale. Digests are counted first, on rows without payload. A bitmap over hashed digests that several
pages share (``bitmap_construct_agg``: see ``bitmaps``; its broadcast is bounded at any size of
input) splits the pages: one whose bit is not set shares its
payload with no other and goes from the scan to the store without a shuffle, which holds for all but a
share of about one in sixteen unshared payloads; the rest meet the shared digests in a join, which
keeps one row of each. Reading joins small header rows with payloads by digest; a hot digest's header
rows are split by AQE's skew join. Both tables are written as Parquet by Spark's committer.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyframe.llm.bitmaps import marked
from canopyframe.plans.lineage import cut, scratch

#: Payloads of fewer bytes are never referred to.
LEAST_REVISIT = 100
CRLF = "\r\n"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT, date: str | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``headers (page_id, header, http, payload_digest, refers_to)`` and ``payloads (payload_digest, payload)``.

    Page ids may be of any orderable type, which both columns have; in a header they stand URL-encoded.

    ``date`` is the capture time, a timestamp column or a text as WARC-Date has it; the present if not given.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    if isinstance(date, Column):
        when = F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    else:
        when = F.lit(date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), when.alias("date"), F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("n"))
    # rows are numbered once and for all, since a page id may stand in several of them
    slim = cut(slim.withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row"))
    shared = slim.groupBy("payload_digest").agg(first.alias("m"), F.count("*").alias("copies")).filter("copies > 1")
    shared = cut(shared.select(F.col("payload_digest").alias("digest"), F.col("m.page_id").alias("first"), F.col("m.row").alias("first_row")))

    base = pages.select(F.sha2(payload, 256).alias("payload_digest"), payload.alias("payload"))
    met, may = marked(base, "payload_digest", shared.select("digest"))
    sure = met.filter(~may).select("payload_digest", "payload")
    # equal payloads are one row of each task before they are shuffled, and one row after
    doubtful = met.filter(may).groupBy("payload_digest").agg(F.any_value("payload").alias("payload"))
    payloads = sure.unionByName(doubtful)

    slim = slim.join(shared, F.col("payload_digest") == F.col("digest"), "left")
    revisit = (F.col("n") >= least) & F.col("first_row").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))
    # header values are single lines: line ends in a URL are percent-encoded
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    urn = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page.cast("string")), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(2 * CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"), F.col("row"))),
        line("WARC-Date", F.coalesce("date", F.lit("1970-01-01T00:00:00Z"))),
        line("WARC-Target-URI", F.coalesce(url, F.lit("urn:page:unknown"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("first"), F.col("first_row")))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")),
        F.lit(CRLF),
    )
    refers_to = F.when(revisit, F.col("first")).alias("refers_to")
    return slim.select("page_id", F.encode(header, "UTF-8").alias("header"), F.encode(http, "UTF-8").alias("http"), "payload_digest", refers_to), payloads


def write_archive(pages: DataFrame, folder: str, **columns) -> str:
    """Writes both tables of ``pages``' archive under ``folder``, which must be shared."""
    headers, payloads = records(pages, **columns)
    headers.write.mode("errorifexists").parquet(f"{folder}/headers")
    payloads.write.mode("errorifexists").parquet(f"{folder}/payloads")
    return folder


def field(header: Column, name: str) -> Column:
    """A header field's value, or null."""
    found = F.regexp_extract(header, f"(?:^|\\n){name}: ([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Records by join: ``page_id, header, payload, record`` and the parsed header fields.

    ``record`` is the record's exact bytes (header, block, two line ends; a revisit's block is its
    HTTP head) and ``payload`` the full payload, for revisits too. A payload that its digest does not confirm
    stops the read, as does a header whose payload is missing.
    """
    headers = spark.read.parquet(f"{folder}/headers")
    stored = spark.read.parquet(f"{folder}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("payload_digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is not as digested: "), "payload_digest")).cast("binary"))
    rows = headers.join(stored.select("payload_digest", sound.alias("payload")), "payload_digest", "left")
    text = F.decode("header", "UTF-8")
    payload = F.coalesce("payload", F.raise_error(F.concat(F.lit("payload is missing: "), "payload_digest")).cast("binary"))
    rows = rows.select("page_id", "refers_to", text.alias("t"), "header", "http", payload.alias("payload"))
    kind = field(F.col("t"), "WARC-Type")
    block = F.when(kind == "revisit", F.col("http")).otherwise(F.concat("http", "payload"))
    return rows.select(
        "page_id",
        "header",
        "payload",
        F.concat("header", block, F.lit(2 * CRLF).cast("binary")).alias("record"),
        kind.alias("record_type"),
        field(F.col("t"), "WARC-Target-URI").alias("url"),
        F.regexp_extract(F.coalesce(field(F.col("t"), "WARC-Payload-Digest"), F.lit("")), "^sha256:(.*)$", 1).alias("payload_digest"),
        "refers_to",
        field(F.col("t"), "Content-Length").cast("long").alias("content_length"),
    )


def archive_and_read(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes ``pages`` as an archive and reads it back, a row per page as ``read_archive`` gives it.

    A null payload counts as empty and so is a response. A record id is made of the page id and the
    row's number, so that repeated rows, which make a record each, differ in it. Rows with a null id are
    revisits beside an equal payload with an id. The repeats of a response's own id are responses. A
    null URL reads ``urn:page:unknown``. Other columns are not looked at. An empty table gives an empty
    archive. Payloads are kept whole.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    return read_archive(spark, write_archive(pages, folder, **columns))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM r
"""
