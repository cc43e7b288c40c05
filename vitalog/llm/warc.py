"""WARC archives, index first.

Writing gives one archive per task, each record a gzip member of its own, and an index row with path, offset, length, URL and
digest per record. Reading starts from the index: chosen rows are sorted by place, neighbouring byte ranges
are read at once, and the records are cut out of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import new_folder, opened
from .common import written

CHUNK_BYTES = 16 << 20
GAP_BYTES = 64 << 10
#: Bytes of archive that a task reads, where that makes more tasks than the session's shuffle partitions.
TASK_BYTES = 256 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, url string, record_type string, digest string, path string, offset long, length long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit has the HTTP header of its page and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
             f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (names in lower case), HTTP header and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, offset = None, None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, sha, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        # a name of its own for each attempt: only attempts that ended have their rows in the index
                        uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        system, place = opened(uri)
                        out, path = system.open_output_stream(place, compression=None), uri
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record(page_id, url, html, digest, refers_to, date)) + packer.flush()
                    out.write(member)
                    rows.append((page_id, url, "response" if refers_to is None else "revisit", digest, path, offset, len(member)))
                    offset += len(member)
                names = ["page_id", "url", "record_type", "digest", "path", "offset", "length"]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        finally:
            if out is not None:
                out.close()
    return run


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page into archives under ``folder`` (shared by all executors) and return the index.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the smallest page_id is a response
    and the others revisit it; smaller payloads are all responses. Null html is an empty payload, a null url an empty
    one. Rows that repeat the smallest page_id are responses too, as are equal payloads that all lack a page_id;
    beside others, a row without page_id revisits. An empty table writes no archive. The index is a
    table in the shared folder: page_id, url, record_type, digest, path, offset, length.
    """
    spark = pages.sparkSession
    if folder is None:
        folder = new_folder(spark, "warc")
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"), F.sha1(html).alias("sha"))
    equal = rows.filter(F.length("html") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    equal = written(equal.filter("n > 1 AND first IS NOT NULL").select("sha", "first"), "warc-equal")
    revisit = (F.length("html") >= least_bytes) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    chosen = rows.join(equal, "sha", "left").select("page_id", "url", "html", "sha", F.when(revisit, F.col("first")).alias("refers_to"))
    return written(chosen.mapInArrow(_write(folder, date), _INDEX), "warc-index")


def coalesced(places: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[int]]]:
    """Join sorted (offset, length) places into ranges: start, end, and the numbers of the places inside."""
    start, end, inside = 0, -1, []
    for number, (offset, length) in enumerate(places):
        if inside and (offset - end > gap or offset + length - start > most):
            yield start, end, inside
            inside = []
        if not inside:
            start, end = offset, offset
        end = max(end, offset + length)
        inside.append(number)
    if inside:
        yield start, end, inside


def _read(with_payload: bool):
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload

    def record_row(raw: bytes) -> tuple:
        fields, http, payload = parsed(raw)
        kind = fields["warc-type"]
        if kind == "response":
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if fields["warc-payload-digest"] != f"sha1:{digest}":
                raise ValueError(f"damaged record {fields['warc-record-id']}: its payload has digest {digest}")
        else:
            size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
        number = lambda name: int(fields[name]) if name in fields else None
        row = (number("x-page-id"), fields["warc-target-uri"], size, digest, kind, number("x-refers-to-page-id"))
        return (*row, payload if kind == "response" else None) if with_payload else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_path: dict[str, list[tuple[int, int]]] = {}
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_path.setdefault(path, []).append((offset, length))
            for path, places in by_path.items():
                places.sort()
                system, place = opened(path)
                with system.open_input_file(place) as archive:
                    for start, end, inside in coalesced(places):
                        archive.seek(start)
                        data = archive.read(end - start)
                        rows = [record_row(zlib.decompress(data[places[i][0] - start:sum(places[i]) - start], 31)) for i in inside]
                        yield pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)],
                                              [n for n, _ in kinds])
    return run


def read(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read the records of the given index rows from their archives.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to and, on request, payload (null for
    revisits). Digests of responses are computed from the bytes read and must equal those in the header.
    """
    chunk = F.floor(F.col("offset") / CHUNK_BYTES)
    # index rows are small: what a task gets follows from the bytes they stand for
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(size // CHUNK_BYTES, max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)))
    places = index.select("path", "offset", "length").repartition(tasks, "path", chunk).sortWithinPartitions("path", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return places.mapInArrow(_read(with_payload), schema + (", payload binary" if with_payload else ""))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, body, sha1(body) AS h FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = min(page_id) OVER same THEN NULL ELSE min(page_id) OVER same END AS refers_to
FROM d WINDOW same AS (PARTITION BY body)
"""
