"""WARC: pages written as request, response and metadata records, and assembled again into captures.

Archives are tables of bounded segments, each a run of gzip members as in a .warc.gz file, written by Spark to the
shared folder. Reading parses every record, verifies lengths and digests, and joins the records of a transaction
through their concurrent-to identifiers into one nested row for each capture. Equal payloads are stored once, as the
response with the largest page_id; the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantle.llm.common import sized, written

#: Bytes after which a segment ends; one larger record makes a larger segment.
SEGMENT = 1 << 20
#: Bytes given to the decompressor at once.
SLICE = 1 << 14
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member that holds a record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _line(value) -> str:
    return re.sub(r"[\r\n]+", " ", value or "")


def transaction(page: str, url: str | None, payload: bytes, owner: str | None) -> bytes:
    """The records of a page; owner is the page whose response a revisit refers to."""
    main, target = f"<urn:capture:{page}:response>", _line(url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    common = [("WARC-Target-URI", target), ("WARC-Date", DATE)]
    headers = [("WARC-Type", "revisit" if owner else "response"), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload))]
    if owner:
        headers += [("WARC-Refers-To", f"<urn:capture:{owner}:response>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    path = re.sub(r"^[a-z]+://[^/]*", "", target).replace(" ", "%20") or "/"
    ask = f"GET {path} HTTP/1.1\r\n\r\n".encode()
    note = f"payload-bytes: {len(payload)}\r\n".encode()
    side = lambda kind: [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:capture:{page}:{kind}>"), ("WARC-Concurrent-To", main), *common]
    return record(side("request"), ask) + record(headers, http if owner else http + payload) + record(side("metadata"), note)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def segment():
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["content"])

    for batch in batches:
        for page, url, html, owner in zip(*(batch.column(n) for n in ("capture", "url", "html", "owner"))):
            held.append(transaction(page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), owner.as_py()))
            size += len(held[-1])
            if size >= SEGMENT:
                yield segment()
                held, size = [], 0
    if held:
        yield segment()


def archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Segments (content) of the pages' archives, in the shared folder.

    A capture is named by its page_id. Pages without one, and all pages of an id that occurs more than once, are named
    by id and row, whatever their payloads. A payload of least_bytes or more that another page with a larger id has is
    a revisit of one page of the largest id.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    single = source.withColumn("name", F.col("page_id").cast("string"))
    again = source.groupBy("page_id").count().where("count > 1 or page_id is null")
    again = written(again.select("page_id", F.lit(True).alias("again")), "again")
    if not again.isEmpty():
        own = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit("."), F.monotonically_increasing_id().cast("string"))
        repeated = source.where("page_id is null").unionByName(source.join(sized(again), "page_id", "left_semi"))
        repeated = written(repeated.withColumn("name", own), "repeated")
        single = single.where("page_id is not null").join(sized(again), "page_id", "left_anti").unionByName(repeated)
    keyed = single.withColumn("payload", F.unhex(F.sha1(F.col("html").cast("binary"))))
    small = written(keyed.select("page_id", "name", "payload", (F.octet_length("html") >= least_bytes).alias("shared")), "payloads")
    owners = small.where("shared and page_id is not null").groupBy("payload").agg(F.max(F.struct("page_id", "name")).alias("last"))
    many = small.where("shared").groupBy("payload").count().where("count > 1").select("payload")
    owners = written(owners.join(many, "payload").select("payload", "last.*").toDF("payload", "last", "owner"), "owners")
    out = keyed.join(sized(owners), "payload", "left")
    owner = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("owner"))
    return written(out.select(F.col("name").alias("capture"), "url", "html", owner.alias("owner")).mapInArrow(_write, "content binary"), "archive")


def members(content: bytes) -> Iterator[bytes]:
    """The gzip members of a segment or a whole .warc.gz file, which is fed in slices, so that time grows with its size."""
    at, size, rest = 0, len(content), memoryview(content)
    while at < size:
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            if at >= size:
                raise ValueError("the last member is cut off")
            piece = rest[at : at + SLICE]
            parts.append(unzip.decompress(piece))
            at += len(piece) - len(unzip.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(headers["content-length"])
    if not lines[0].startswith("WARC/") or len(rest) < length:
        raise ValueError(f"broken record {headers.get('warc-record-id')}")
    return headers, rest[:length]


RECORDS = "kind string, record_id string, concurrent_to string, target_uri string, warc_date string, refers_to string, payload_bytes long, payload_digest string, block_bytes long, note string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in RECORDS.split(", ")]
    for batch in batches:
        rows = []
        for content in batch.column("content"):
            for data in members(content.as_py()):
                h, block = parse(data)
                kind, stated, size, note = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None
                if kind in ("response", "revisit"):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
                    if kind == "response" and (len(payload) != size or base32_sha1(payload) != stated):
                        raise ValueError(f"payload of {h['warc-record-id']} isn't what its headers say")
                else:
                    note = block.decode("utf-8", "replace").split("\r\n", 1)[0]
                rows.append((kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), size, stated, len(block), note))
        longs = {"payload_bytes", "block_bytes"}
        columns = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in longs else pa.string()) for n, c in zip(names, columns)], names=names)


def records(segments: DataFrame) -> DataFrame:
    """Every record of the segments; also of whole files, as spark.read.format("binaryFile") gives them."""
    return segments.select("content").mapInArrow(_read, RECORDS)


def captures(found: DataFrame) -> DataFrame:
    """One nested row for each capture: the main record, and structs request and metadata where there are such.

    The transaction's key is the main record's identifier, which the others name in concurrent-to; all its records
    meet in one aggregation. Records whose main record is missing make a row of kind orphan under the identifier they
    name; a record that names nothing stands for itself.
    """
    side = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("record_id", "block_bytes", "note"))).alias(kind)
    main = F.struct("kind", "record_id", "target_uri", "warc_date", "refers_to", "payload_bytes", "payload_digest")
    grouped = found.groupBy(F.coalesce("concurrent_to", "record_id").alias("transaction")).agg(
        F.collect_list(F.when(F.col("kind").isin("response", "revisit"), main)).alias("main"), side("request"), side("metadata")
    )
    rows = grouped.select(F.explode_outer("main").alias("m"), "request", "metadata", "transaction").select("m.*", "request", "metadata", "transaction")
    orphan = F.col("kind").isNull()
    rows = rows.withColumn("record_id", F.when(orphan, F.col("transaction")).otherwise(F.col("record_id")))
    return rows.withColumn("kind", F.coalesce("kind", F.lit("orphan"))).drop("transaction")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to and the nested capture, read back from its
    archives. A capture without its request or metadata record fails the read.

    A null html counts as empty. Pages with a null id are captures of their own, with a null page_id, and so are pages that
    repeat an id, whatever their payloads. Rows that repeat an id and its payload are all responses, or all revisits of a
    page with a larger id. An empty table gives an empty one.
    """
    of = lambda c: F.regexp_extract(c, r"^<urn:capture:(-?\d+)(?:\.\d+)?:response>$", 1)
    number = lambda c: F.when(of(c) != "", of(c).cast("long"))
    found = captures(records(archives(pages, least_bytes)))
    whole = F.col("request").isNotNull() & F.col("metadata").isNotNull() & (F.col("metadata.note") == F.concat(F.lit("payload-bytes: "), F.col("payload_bytes").cast("string")))
    capture = F.when(F.coalesce(whole, F.lit(False)), F.struct("request", "metadata", "target_uri", "warc_date")).otherwise(F.raise_error(F.concat(F.lit("incomplete capture "), "record_id")))
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"), capture.alias("capture"))
