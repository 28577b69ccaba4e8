"""WARC archives of page payloads, and their records put together again from segments.

Writing. Each task writes one gzip-per-record WARC 1.1 file. A payload travels as an HTTP response in chunked
transfer coding. Of the rows with equal payloads, the one with the largest page_id gets a response record and
the others revisit records, which name its record, address and date and hold no payload. A block longer than `segment_bytes` is cut: the
first segment keeps the record's type, the others are continuation records with the first one's id as their
origin and the segment number; the last one states the total length.

Reading. Files are dealt over tasks and parsed record by record. Segments are grouped by file and origin, put
in order of segment number, checked to be complete and as long as stated, and joined; then the chunked coding
is undone and the payload's digest is checked. A record that fails a check raises an error.

Edge cases: a null html is an empty payload; rows with a null page_id are archived and never referred to; all
rows of the largest page_id among equal payloads are responses; smaller payloads than `min_bytes` are always
responses; repeated rows each get a record; extra columns are ignored; an empty table gives no records.
"""

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

from siteloom.llm.common import bounded_broadcast, materialize, salted_join, shared_dir, small_batches, table
from siteloom.llm.tokens import open_store

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
#: Payloads of at least so many bytes can be revisited.
MIN_BYTES = 0
#: Digests that may be broadcast.
MAX_BROADCAST = 200_000
DATE = "2024-01-01T00:00:00Z"
RECORDS = "file string, origin string, number int, last_total long, type string, page_id long, refers_to long, digest string, block binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_chunks(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """RFC 9112 chunked transfer coding."""
    out = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*out, b"0\r\n\r\n"])


def decode_chunks(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        at = end + 4 + size


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    checked = [*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", len(block))]
    head = "".join(f"{k}: {v}\r\n" for k, v in checked if v is not None)
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + z.flush()


def uri(url: str | None) -> str | None:
    return "".join(c for c in url or "" if c > " ") or None


def response_id(page_id: int | None, sha: str, copy: str = "") -> str:
    """A response's record id follows from its page and payload, so that revisits in other files can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {sha}{copy}')}>"


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, ids: Iterator[str], written: set[str], segment_bytes: int) -> Iterator[bytes]:
    """A page's records: a revisit, or a response in one or more segments. `written` are the file's response ids."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    sha = digest(payload)
    common = [("WARC-Target-URI", uri(url)), ("WARC-Date", DATE), ("X-Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{sha}")]
    kind = [("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        known = [("WARC-Refers-To", response_id(refers_to, sha)), ("WARC-Refers-To-Target-URI", uri(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", refers_to)]
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", next(ids)), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *known, *kind]
        yield record(fields, http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + encode_chunks(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    origin = response_id(page_id, sha)
    if origin in written:
        origin = response_id(page_id, sha, next(ids))
    written.add(origin)
    for k, part in enumerate(parts, 1):
        if k == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, *kind]
            fields += [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", next(ids)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", k)]
            fields += [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        yield record(fields, part)


def with_referrals(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages(page_id, url, html) with refers_to, refers_url: the row of the largest page_id of the same payload, null if it is the row's own.

    Only 20-byte digests are grouped, partly in the tasks. The digests that repeat are broadcast if they are few
    enough, so that no html moves; else they are joined, a much repeated one over salted copies.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.withColumn("key", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    large = F.octet_length("html") >= min_bytes
    last = keyed.where(large).groupBy("key").agg(F.max("page_id").alias("last"), F.max_by("url", "page_id").alias("last_url"), F.count("*").alias("n")).where("n > 1").select("key", "last", "last_url")
    last = materialize(last, "repeated")
    small = bounded_broadcast(last, MAX_BROADCAST)
    joined = keyed.join(small, "key", "left") if small is not last else salted_join(keyed, last, "key", "left")
    refers = F.when(large & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last"))), F.col("last"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"), F.when(refers.isNotNull(), F.col("last_url")).alias("refers_url"))


def write_archives(pages: DataFrame, uri: str, min_bytes: int = MIN_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes pages(page_id, url, html) to WARC files under uri; returns (file, records), one row a file."""
    small_batches(pages.sparkSession)
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(uri)
        part, n = TaskContext.get().partitionId(), 0
        name, temp = f"pages-{part:06d}.warc.gz", uuid.uuid4().hex

        def fresh() -> Iterator[str]:
            k = 0
            while True:
                yield f"<urn:uuid:{uuid.UUID(int=(part << 64) | k)}>"
                k += 1

        ids, written = fresh(), set()
        with store.open_output_stream(f"{path}/{name}.{temp}.part", compression=None) as out:
            for b in batches:
                if not n:
                    out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", next(ids)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                for page_id, url, html, refers_to, refers_url in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "refers_url")), strict=True):
                    for data in page_records(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, refers_url, ids, written, segment_bytes):
                        out.write(data)
                        n += 1
        if n:
            store.move(f"{path}/{name}.{temp}.part", f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])
        else:
            store.delete_file(f"{path}/{name}.{temp}.part")

    return materialize(with_referrals(pages, min_bytes).mapInArrow(write, "file string, records long"), "warc-files")


def parse(store: object, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a file of gzip members."""
    data = b""
    with store.open_input_stream(path, compression=None) as f:
        z, text = zlib.decompressobj(31), b""
        while True:
            if not data:
                data = f.read(1 << 20)
                if not data:
                    break
            text += z.decompress(data)
            data = z.unused_data
            if not z.eof:
                data = b""
                continue
            head, _, rest = text.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            if rest[size:] != b"\r\n\r\n":
                raise ValueError(f"{path}: a record is not as long as its Content-Length")
            yield fields, rest[:size]
            z, text = zlib.decompressobj(31), b""
        if text:
            raise ValueError(f"{path}: the last record is cut off")


def read_records(files: DataFrame, uri: str) -> DataFrame:
    """Records as they stand in the files, segments apart."""
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(uri)
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for name in b.column("file").to_pylist():
                rows = []
                for f, block in parse(store, f"{path}/{name}"):
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    number = lambda k, f=f: int(f[k]) if k in f else None
                    origin = f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"])
                    rows.append((name, origin, number("WARC-Segment-Number") or 1, number("WARC-Segment-Total-Length"), f["WARC-Type"], number("X-Page-Id"), number("X-Refers-To-Page-Id"), f.get("WARC-Payload-Digest", "").removeprefix("sha1:"), block))
                    if len(rows) >= 500:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return files.repartition(n).mapInArrow(read, RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to and the payload (null for revisits).

    A group is one record's segments, so its size is bounded by the record's.
    """
    segments = F.array_sort(F.collect_list(F.struct("number", "block", "last_total")))
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    whole = records.groupBy("file", "origin").agg(segments.alias("segments"), F.max("last_total").alias("total"), *[first(c) for c in ("type", "page_id", "refers_to", "digest")])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, payloads = [], []
            for segs, total, kind, sha, origin in zip(*(b.column(c).to_pylist() for c in ("segments", "total", "type", "digest", "origin")), strict=True):
                block = b"".join(s["block"] for s in segs)
                if [s["number"] for s in segs] != list(range(1, len(segs) + 1)) or total is not None and total != len(block) or total is None and len(segs) > 1:
                    raise ValueError(f"{origin}: segments are missing")
                head, _, body = block.partition(b"\r\n\r\n")
                fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
                if kind == "revisit":
                    size.append(int(fields[b"Content-Length"]))
                    payloads.append(None)
                    continue
                payload = decode_chunks(body) if fields.get(b"Transfer-Encoding") == b"chunked" else body
                if digest(payload) != sha:
                    raise ValueError(f"{origin}: the payload does not have its digest")
                size.append(len(payload))
                payloads.append(payload)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(size, pa.int64()), b.column("digest"), b.column("type"), b.column("refers_to"), pa.array(payloads, pa.binary())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return whole.mapInArrow(join, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = shared_dir(spark, "warc")
    files = write_archives(table(spark, sf_dir, "pages"), uri)
    return reassemble(read_records(files, uri)).drop("payload")
