"""WARC archives: writing captures as records, reading them back, and assembling captures from their records."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import shared_folder
from .joins import skew_join

END = "\r\n\r\n"
#: Fixed names of the format.
VERSION, REVISIT_PROFILE = "WARC/1.0", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of records in a file before compression, apart from the record that passes the limit.
FILE_BYTES = 32 << 20
#: Bytes that are unzipped at once.
CHUNK = 1 << 20


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                payloads = [(x or "").encode() for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([sha1_base32(p) for p in payloads]), pa.array([len(p) for p in payloads], type=pa.int64())], names=["page_id", "url", "html", "digest", "payload_bytes"]
                )

    kind, url = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url {url}, html string, digest string, payload_bytes bigint")


def _record(headers: dict[str, str], block: bytes) -> bytes:
    head = [VERSION, *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END.encode() + block


def _plain(url: str) -> str:
    """A header's value holds no line ends or other control characters."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _records(page_id: str, url: str, html: str, digest: str, revisited: str | None, unique: str) -> Iterator[bytes]:
    """The request, the response or revisit, and the metadata of one capture."""
    names = {x: f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{unique}:{x}').urn}>" for x in ("request", "capture", "metadata")}
    common = {"WARC-Target-URI": _plain(url), "WARC-Date": DATE}
    http = {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
    request = f"GET {_plain(url) or '/'} HTTP/1.1\r\n\r\n".encode()
    payload = html.encode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    yield _record({"WARC-Type": "request", "WARC-Record-ID": names["request"], "WARC-Concurrent-To": names["capture"], **common, "Content-Type": "application/http; msgtype=request"}, request)
    if revisited is None:
        yield _record({"WARC-Type": "response", "WARC-Record-ID": names["capture"], **common, **http}, head + payload)
    else:
        yield _record({"WARC-Type": "revisit", "WARC-Record-ID": names["capture"], "WARC-Refers-To": f"<urn:page:{revisited}>", "WARC-Profile": REVISIT_PROFILE, **common, **http}, head)
    fields = f"page-id: {page_id}\r\npayload-length: {len(payload)}\r\n".encode()
    yield _record({"WARC-Type": "metadata", "WARC-Record-ID": names["metadata"], "WARC-Concurrent-To": names["capture"], **common, "Content-Type": "application/warc-fields"}, fields)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes each page (page_id, url, html) as a request, a response or revisit, and a metadata record.

    Of captures whose payloads (the html in UTF-8) are equal and have `least_bytes` or more, the one with the largest page_id
    is a response and the others are revisits that refer to it; of repeated rows of that page all are responses. Shorter payloads
    are all responses. Null html or url is empty. A null page_id is written as empty; it never is the page revisited unless all ids
    of the payload are null, and then all are responses. Spark's text writer makes the files (gzip, one after another complete
    WARC records, whose closing line ends are the writer's separators), so they go to any file system that Spark knows. Each task begins
    another file after `file_bytes` of records, in folders by the number of its file.
    """
    known = _digests(pages)
    latest = known.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("latest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, written = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                out, file = [], []
                for page_id, url, html, digest, revisited in zip(*(c.to_pylist() for c in batch.slice(i, 200).columns), strict=True):
                    for record in _records("" if page_id is None else page_id, url or "", html or "", digest, revisited, f"{task}.{n}"):
                        out.append(record)
                        file.append(written // file_bytes)
                        written += len(record) + len(END)
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(out).cast(pa.string()), pa.array(file, type=pa.int32())], names=["value", "file"])

    joined = skew_join(known, latest, ["digest"], "left")
    revisited = F.when(~F.col("page_id").eqNullSafe(F.col("latest")) & F.col("latest").isNotNull(), F.col("latest").cast("string"))
    lines = joined.select(F.col("page_id").cast("string"), F.col("url").cast("string"), "html", "digest", revisited.alias("revisited")).mapInArrow(run, "value string, file int")
    lines.write.option("compression", "gzip").option("lineSep", END).partitionBy("file").text(path)


def _plain_chunks(raw: bytes) -> Iterator[bytes]:
    """The archive's bytes piece by piece, unzipped if it's gzip of any number of members; what can't be unzipped ends it."""
    view = memoryview(raw)
    if raw[:2] != b"\x1f\x8b":
        for at in range(0, len(raw), CHUNK):
            yield bytes(view[at : at + CHUNK])
        return
    at, unzip = 0, zlib.decompressobj(31)
    pending = b""
    while True:
        if not pending:
            if at >= len(raw):
                return
            pending = bytes(view[at : at + CHUNK])
            at += CHUNK
        try:
            piece = unzip.decompress(pending, CHUNK)
        except zlib.error:
            return
        pending = unzip.unconsumed_tail
        if unzip.eof:
            pending, unzip = unzip.unused_data, zlib.decompressobj(31)
        if piece:
            yield piece


def parse_archive(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each whole record; blocks are told by their length, whatever they hold.

    Only the record being read is held unzipped. A head without a valid length is skipped up to the next record; a record that the
    archive cuts off, and what follows bytes that can't be unzipped, is left out.
    """
    chunks, held, over = _plain_chunks(raw), bytearray(), False

    def more() -> bool:
        nonlocal over
        piece = next(chunks, None)
        over = over or piece is None
        held.extend(piece or b"")
        return not over

    seen = 0
    while True:
        while (begin := held.find(b"WARC/", max(0, seen - 4))) < 0:
            seen = len(held)
            if not more():
                return
        del held[:begin]
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                return
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in held[:end].decode(errors="replace").split("\r\n")[1:])}
        length = headers.get("content-length", "")
        seen = 0
        if not (length.isascii() and length.isdigit()):
            del held[:5]
            continue
        while len(held) < end + 4 + int(length):
            if not more():
                return
        yield headers, bytes(held[end + 4 : end + 4 + int(length)])
        del held[: end + 4 + int(length)]


RECORD = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, digest string, payload binary, fields map<string,string>"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each whole record of the archives in a folder and those in it (see parse_archive for damaged ones).

    A file is one row of Spark's binary reader, so it's read compressed; the writer keeps files small. It's unzipped piece by piece.

    `payload` is what follows the HTTP head in a response (null in others, or without `payloads`), `digest` is that of the payload for a
    response, else the header's; `fields` are a metadata record's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.binary(), pa.map_(pa.string(), pa.string())]
        names = ["type", "record_id", "concurrent_to", "refers_to", "target_uri", "digest", "payload", "fields"]
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for headers, block in parse_archive(batch.column(0)[k].as_py()):
                    kind, payload, fields, digest = headers.get("warc-type"), None, None, headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = sha1_base32(payload)
                        fields = [("payload-length", str(len(payload)))]
                    elif kind == "metadata":
                        fields = [(a.strip(), b.strip()) for a, c, b in (x.partition(":") for x in block.decode(errors="replace").split("\r\n")) if c]
                    rows.append((kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), digest, payload if payloads else None, fields))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the records that name it in their concurrent-to identifier meet it by that.

    Returns capture_id, target_uri, capture (type, digest, payload, refers_to, fields), request and metadata (fields), null where such a record is missing.
    Records of other types or without identifiers, and requests and metadata without a capture, are left out; of several records of a kind
    for one capture that with the least identifier is taken, so reruns agree. No groups grow: a capture has a few records.
    """
    key = F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).when(F.col("type").isin("request", "metadata"), F.col("concurrent_to"))
    columns = ("type", "record_id", "target_uri", "digest", "refers_to", "payload", "fields")

    def one(*types: str) -> F.Column:
        own = F.col("type").isin(*types)
        return F.min_by(F.when(own, F.struct(*columns)), F.when(own, F.struct(F.coalesce("record_id", F.lit("")), "type", F.coalesce("digest", F.lit("")))))

    joined = records.withColumn("capture_id", key).where("capture_id is not null").groupBy("capture_id").agg(one("response", "revisit").alias("capture"), one("request").alias("request"), one("metadata").alias("metadata"))
    return joined.where("capture is not null").select("capture_id", "capture.target_uri", "capture", "request", "metadata")


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
