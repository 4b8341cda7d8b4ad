"""Content-addressed WARC archive.

``write_archive`` keeps every payload once, addressed by its SHA-256, as a WARC ``resource`` record
in gzipped segments, and keeps the exact header block of every page's own record (``response`` or
``revisit``) in a separate table.  ``read_archive`` parses the segments by their Content-Length,
recomputes each digest before it trusts it, and ``reconstruct`` joins headers and payloads back to
the original records, byte for byte.

Payload bytes travel once (a join on the page that supplies them, so no digest is a hot key); who
supplies them is decided on digests alone, summed before they are shuffled.

Edge cases: a null html is an empty payload.  Blanks and control characters of a url are
percent-encoded in WARC-Target-URI; such a url, and a null one (written as ``about:blank``), has its
exact form in a header of its own, so every url comes back as it was.  Payloads of fewer than 100
bytes are always responses.  Rows that repeat page_id and payload are the same record written again.
A null page_id never serves as the original unless all pages of its payload have none, whose records
then are all responses.  However often rows repeat, a payload is stored once.  Very long payloads have
a segment of their own.  Empty tables give an empty archive.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import work

LEAST_REVISIT = 100
END = "\r\n\r\n"
#: Payloads of up to so many bytes share segments of so many records: no segment is over 64 MiB but that of one longer payload.
SEGMENTS = ((1 << 16, 1 << 10), (1 << 22, 1 << 4), (1 << 62, 1))
#: What no WARC header may hold in a url, and the header with the exact url where it does.
ILLEGAL = r"[\x00-\x20\x7F]"
EXACT_URL, NO_URL = "X-Exact-URL", "none"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _lines(*fields: tuple[str, Column] | Column) -> Column:
    """A header block of named fields; a bare column is a whole line already, or empty."""
    line = lambda f: f if isinstance(f, Column) else F.concat(F.lit(f"{f[0]}: "), f[1].cast("string"), F.lit("\r\n"))
    return F.concat(F.lit("WARC/1.1\r\n"), *map(line, fields), F.lit("\r\n"))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _escaped(url: Column) -> Column:
    """The url with blanks and control characters percent-encoded."""
    sign = lambda c: F.when(c.rlike(ILLEGAL), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    return F.when(url.rlike(ILLEGAL), F.array_join(F.transform(F.split(url, ""), sign), "")).otherwise(url)


def _key(page: str) -> list[Column]:
    """A page_id as two columns that are never null."""
    return [F.coalesce(page, F.lit(0)).alias("page"), F.col(page).isNull().alias("unknown")]


def _header() -> Column:
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    url = _escaped(F.coalesce("url", F.lit("about:blank")))
    exact = F.when(F.col("url").isNull(), F.lit(NO_URL)).when(F.col("url").rlike(ILLEGAL), F.url_encode("url"))
    extra = F.coalesce(F.concat(F.lit(f"{EXACT_URL}: "), exact, F.lit("\r\n")), F.lit(""))
    common = [("WARC-Record-ID", _urn(F.col("page_id"))), ("WARC-Target-URI", url), ("WARC-Date", F.lit(DATE)), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), ("Content-Type", F.lit("application/http; msgtype=response"))]
    whole = _lines(("WARC-Type", F.lit("response")), *common, extra, ("Content-Length", F.octet_length(http) + F.col("bytes")))
    again = _lines(("WARC-Type", F.lit("revisit")), *common, extra, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", _urn(F.col("original"))), ("Content-Length", F.octet_length(http)))
    return F.concat(F.when(F.col("record_type") == "response", whole).otherwise(again), http)


def write_archive(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) under ``path``: ``payload`` holds segments, ``headers`` the record headers."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    facts = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.xxhash64("payload").alias("mark"))
    facts = work.staged(facts, "warc-facts")
    # A digest stands for its bytes only if length and a second hash agree throughout the group.
    per_page = facts.groupBy("digest", "page_id").agg(F.count("*").alias("copies"), F.min("bytes").alias("lo"), F.max("bytes").alias("hi"), F.min("mark").alias("m1"), F.max("mark").alias("m2"))
    first = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "copies")
    owners = per_page.groupBy("digest").agg(F.min(first).alias("first"), F.max("hi").alias("bytes"), ((F.min("lo") == F.max("hi")) & (F.min("m1") == F.max("m2"))).alias("sure"))
    sure = F.when(F.col("sure"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payloads differ under digest "), "digest")))
    owners = work.staged(owners.select(sure.alias("digest"), F.col("first.page_id").alias("original"), F.col("first.copies").alias("copies"), "bytes"), "warc-owners")
    f, o = facts.alias("f"), owners.alias("o")
    kind = F.when((F.col("bytes") < LEAST_REVISIT) | F.col("page_id").eqNullSafe(F.col("original")), "response").otherwise("revisit")
    headers = f.join(o, F.col("f.digest") == F.col("o.digest")).select("f.*", "o.original").withColumn("record_type", kind)
    headers.select(_header().alias("header")).write.option("maxRecordsPerFile", 1_000_000).parquet(f"{path}/headers")
    record = F.concat(
        _lines(
            ("WARC-Type", F.lit("resource")), ("WARC-Record-ID", F.concat(F.lit("<urn:sha256:"), "digest", F.lit(">"))), ("WARC-Target-URI", F.concat(F.lit("urn:sha256:"), "digest")), ("WARC-Date", F.lit(DATE)),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), ("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.octet_length("payload")),
        ), "payload",
    )
    longest, repeated = owners.agg(F.max("bytes"), F.max("copies") > 1).first()
    least = -1
    for most, records_ in SEGMENTS:
        if longest is None and least < 0 or longest is not None and longest > least:  # an empty archive has its (empty) first folder
            mine = owners.filter((F.col("bytes") > least) & (F.col("bytes") <= most)).select("digest", *_key("original"))
            length = F.octet_length("payload")
            supplied = rows.filter((length > least) & (length <= most)).select("digest", "payload", *_key("page_id"))
            if repeated:  # one row of each page and payload, dealt as the join wants it
                supplied = supplied.dropDuplicates(["digest", "page", "unknown"])
            stored = supplied.join(mine, ["digest", "page", "unknown"], "left_semi")
            out = stored.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_)
            out.mode("append").text(f"{path}/payload")
        least = most
    work.discard(facts, owners)


def records(segment: bytes):
    """(header block, block) of each record of a segment; raises ValueError where the layout is broken."""
    at = 0
    while at < len(segment):
        end = segment.index(END.encode(), at) + 4
        size = re.search(rb"\r\nContent-Length: (\d+)\r\n", segment[at:end])
        if not segment.startswith(b"WARC/1.1\r\n", at) or not size:
            raise ValueError(f"no WARC record at byte {at}")
        stop = end + int(size[1])
        if segment[stop : stop + 4] != END.encode():
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield segment[at:end], segment[end:stop]
        at = stop + 4


def stored_payloads(spark: SparkSession, path: str, with_bytes: bool = True) -> DataFrame:
    """(digest, bytes[, payload]) of every payload in the archive, each digest recomputed and verified."""
    work.short_batches(spark, 1)  # a row is a whole segment
    fields = [("digest", pa.string()), ("bytes", pa.int64())] + ([("payload", pa.binary())] if with_bytes else [])

    def parse(batches):
        kind = pa.schema(fields)
        for batch in batches:
            for content in K.ids_of(batch, "content"):
                rows = []
                for head, block in records(zlib.decompress(content.as_py(), 47)):
                    digest = hashlib.sha256(block).hexdigest()
                    if f"\r\nWARC-Payload-Digest: sha256:{digest}\r\n".encode() not in head:
                        raise ValueError(f"payload {digest} is not what its header says")
                    rows.append((digest, len(block), block)[: len(fields)])
                if rows:
                    yield K.record(kind, *[pa.array(c, f[1]) for c, f in zip(zip(*rows, strict=True), fields, strict=True)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{path}/payload").select("content")
    out = work.staged(files.mapInArrow(parse, "digest string, bytes long" + ", payload binary" * with_bytes), "warc-payloads")
    work.short_batches(spark)
    return out


def record_headers(spark: SparkSession, path: str) -> DataFrame:
    """The header table, with what the headers say: page_id, record_type, digest, refers_to, url."""
    field = lambda name, value="(.*?)": F.regexp_extract("header", rf"\r\n{name}: {value}\r\n", 1)
    exact = field(EXACT_URL)
    url = F.when(exact == NO_URL, None).when(exact != "", F.url_decode(exact)).otherwise(field("WARC-Target-URI"))
    page = lambda name: F.nullif(field(name, "<urn:x-page:(.*?)>"), F.lit("")).cast("string")
    number = lambda c: F.when(c.rlike(r"^-?\d+$"), c.cast("long"))
    return spark.read.schema("header string").parquet(f"{path}/headers").select(
        number(page("WARC-Record-ID")).alias("page_id"), field("WARC-Type").alias("record_type"), field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("digest"), number(page("WARC-Refers-To")).alias("refers_to"), url.alias("url"), "header"
    )


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, digest, record): each original record's bytes; those of a revisit end with its HTTP header."""
    store = stored_payloads(spark, path)
    found = record_headers(spark, path).join(store, "digest")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return found.select("page_id", "url", "record_type", "refers_to", "digest", F.concat(F.col("header").cast("binary"), body, F.lit(END.encode())).alias("record"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record, from verified payloads."""
    store = work.staged(stored_payloads(spark, path, with_bytes=False).groupBy("digest").agg(F.min("bytes").alias("bytes")), "warc-index")
    heads = work.staged(record_headers(spark, path).drop("header", "url"), "warc-heads")
    # Both sides come from tables, so a hot digest can be split between tasks.
    return heads.join(store, "digest").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = work.columns(work.table(spark, sf_dir, "pages"), page_id="long", url="string", html="string")
    path = work.fresh_path(spark, "warc")
    write_archive(pages, path)
    return read_archive(spark, path)


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
     q as (select page_id, strlen(h) as n, sha256(h) as d, min(page_id) over (partition by h) as o from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
       case when n < 100 or page_id = o then 'response' else 'revisit' end as record_type,
       case when n < 100 or page_id = o then null else o end as refers_to
from q
"""
