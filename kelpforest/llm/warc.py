"""WARC archives whose revisit records point at the first response of a payload.

Headers (page, payload digest and size) are summed by digest, so that a digest
shared by a third of all pages is combined before it is shuffled. The response
of a digest carries its payload; all other pages of the digest become revisit
records, headers only, that refer to it. Records are written by Spark's text
writer with a record's end, ``CR LF CR LF``, as separator and a gzip stream per
file: the commit protocol makes lost tasks harmless, and any file system that
Spark reaches will do. Such files don't split, so reading goes through a file's
pieces in order, a record at a time, by ``Content-Length``.

Null and empty payloads are empty and share the digest of nothing. Repeated
rows get a record each; of rows equal in payload and page, one is the response.
A page without an id comes after those that have one, and refers by digest like
any other. Empty tables give empty archives. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforest.llm.common import new_path, stored

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Payloads of at least so many bytes are revisited.
MIN_BYTES = 0
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:kelpforest:warc")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = [x.as_py() for x in batch.column(2)]
        raw = [(b or "").encode() for b in bodies]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), batch.column(2), pa.array([digest_of(x) for x in raw], pa.string()), pa.array(map(len, raw), pa.int64())],
            names=["page_id", "url", "html", "digest", "bytes"],
        )


def digested(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        _digested, "page_id long, url string, html string, digest string, bytes long"
    )


def _order(html: bool):
    fields = [F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url"]
    return F.struct(*fields, *(["html"] if html else []))


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, digest, bytes, payload, refers_id, refers_url, refers boolean, copy): a row per record."""
    found = digested(pages)
    small = found.where(F.col("bytes") < min_bytes).select(
        "page_id", "url", "digest", "bytes", F.coalesce("html", F.lit("")).alias("payload"), F.lit(None).cast("long").alias("refers_id"), F.lit(None).cast("string").alias("refers_url"), F.lit(False).alias("refers"), F.monotonically_increasing_id().alias("copy")
    )
    large = found.where(F.col("bytes") >= min_bytes)
    # Equal rows are counted, then numbered, so that one of them can be the response.
    headers = large.groupBy("digest", "bytes", "page_id", "url").agg(F.count("*").alias("n"))
    headers = stored(headers, "warc-headers")
    first = headers.groupBy("digest").agg(F.min(_order(False)).alias("f"))
    numbered = headers.join(first, "digest").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    is_first = F.col("page_id").eqNullSafe(F.col("f.page_id")) & F.col("url").eqNullSafe(F.col("f.url")) & (F.col("copy") == 0)
    revisits = numbered.where(~is_first).select(
        "page_id", "url", "digest", "bytes", F.lit("").alias("payload"), F.col("f.page_id").alias("refers_id"), F.col("f.url").alias("refers_url"), F.lit(True).alias("refers"), "copy"
    )
    # A response's payload is that of the least page; equal payloads are dropped before the shuffle.
    responses = large.groupBy("digest", "bytes").agg(F.min(_order(True)).alias("f")).select(
        "f.page_id", "f.url", "digest", "bytes", F.coalesce("f.html", F.lit("")).alias("payload"), F.lit(None).cast("long").alias("refers_id"), F.lit(None).cast("string").alias("refers_url"), F.lit(False).alias("refers"), F.lit(0).cast("long").alias("copy")
    )
    out = revisits.unionByName(responses)
    return out.unionByName(small) if min_bytes > 0 else out


def _id(digest: str, page, url, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{digest}|{page}|{url}|{copy}')}>"


def _clean(value: str) -> str:
    return "".join(c for c in value if c not in "\r\n")


def _written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            head = ["WARC/1.1", f"WARC-Type: {'revisit' if r['refers'] else 'response'}"]
            head += [f"WARC-Record-ID: {_id(r['digest'], r['page_id'], r['url'], r['copy'])}", f"WARC-Date: {DATE}"]
            if r["url"] is not None:
                head.append(f"WARC-Target-URI: {_clean(r['url'])}")
            if r["page_id"] is not None:
                head.append(f"X-Page-ID: {r['page_id']}")
            head.append(f"WARC-Payload-Digest: sha1:{r['digest']}")
            if r["refers"]:
                head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(r['digest'], r['refers_id'], r['refers_url'], 0)}", f"WARC-Refers-To-Date: {DATE}"]
                if r["refers_url"] is not None:
                    head.append(f"WARC-Refers-To-Target-URI: {_clean(r['refers_url'])}")
            body = r["payload"]
            head += ["Content-Type: text/html", f"Content-Length: {len(body.encode())}"]
            out.append("\r\n".join(head) + END + body)
        yield pa.record_batch([pa.array(out, pa.string())], names=["value"])


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Archives of all pages at ``path``, gzip files of WARC 1.1 records."""
    records(pages, min_bytes).mapInArrow(_written, "value string").write.option("lineSep", END).option("compression", "gzip").text(path)


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records out of the pieces between ``END``s: the bytes are put together again and cut by content length."""
    names = ["record_id", "record_type", "page_id", "digest", "bytes", "refers_record", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    end, held = END.encode(), bytearray()
    head: dict[str, str] = {}
    start = until = 0
    for batch in batches:
        rows = []
        for piece in batch.column(0):
            held += piece.as_py().encode() + end
            while True:
                if not head:
                    skip = len(held) - len(held.lstrip(b"\r\n"))
                    del held[:skip]
                    start = held.find(end) + len(end)
                    if start < len(end):
                        break
                    lines = held[: start - len(end)].decode().split("\r\n")
                    if lines[0] != "WARC/1.1":
                        raise ValueError(f"no record starts with {lines[0][:40]!r}")
                    head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
                    until = start + int(head["content-length"])
                if len(held) < until:
                    break
                payload = bytes(held[start:until])
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and digest != digest_of(payload):
                    raise ValueError(f"a payload doesn't have the digest {digest}")
                page = head.get("x-page-id")
                rows.append(
                    (head["warc-record-id"], head["warc-type"], int(page) if page else None, digest, len(payload), head.get("warc-refers-to"), payload.decode())
                )
                del held[:until]
                head = {}
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    if head:
        raise ValueError("an archive ends within a record")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, page_id, digest, bytes, refers_record, payload): every record of the archives at ``path``."""
    return (
        spark.read.option("lineSep", END)
        .text(path)
        .mapInArrow(_parsed, "record_id string, record_type string, page_id long, digest string, bytes long, refers_record string, payload string")
    )


def resolved(found: DataFrame) -> DataFrame:
    """Pages with the size of their full payload; revisits take it, and the page they refer to, from their response."""
    heads = found.drop("payload")
    heads = stored(heads, "warc-read")
    responses = heads.where("record_type = 'response'")
    first = responses.select(F.col("record_id").alias("refers_record"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("_bytes"), F.col("digest").alias("_digest"))
    revisits = heads.where("record_type = 'revisit'").join(first, "refers_record", "left")
    return responses.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", "refers_to")
    )


def archive(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives to the shared folder, read them back and resolve revisits."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, min_bytes)
    return resolved(read(spark, path))
