"""Zstandard web archives: a dictionary in a leading skippable frame, then one frame for each WARC record.

Archives are rows (archive, content), so that Spark writes and reads them in any store; files made elsewhere are read
with the `binaryFile` source and give the same rows (`archive_files`).
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import joined, stored

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
ARCHIVES = "archive string, content binary"
RECORDS = (
    "archive string, position long, record_id string, record_type string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, refers_to string, payload binary, error string"
)
PAYLOAD_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*?)[ \t]*\r\n")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def safe_uri(url: str) -> str:
    """Nothing in a header line may be a control character."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record_bytes(record_id: str, url: str | None, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit record (HTTP headers only) when `refers_to` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {safe_uri(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PAYLOAD_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = 1 << 15) -> bytes:
    """A dictionary from sample records; their plain bytes when there are too few to train on."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


class Archive:
    """Bytes of one archive while it is written."""

    def __init__(self, dictionary: bytes, level: int):
        packed = zstd.ZstdCompressor(level=level).compress(dictionary)
        self.parts = [struct.pack("<II", SKIPPABLE, len(packed)), packed] if dictionary else []
        self.size = sum(map(len, self.parts))
        self.records = 0
        known = zstd.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstd.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)

    def add(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.parts.append(frame)
        self.size += len(frame)
        self.records += 1


def frames(content: memoryview) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, skippable) of each frame, found from block headers without decoding."""
    at, total = 0, len(content)
    while at < total:
        if total - at < 8:
            raise ValueError(f"{total - at} bytes after the last frame")
        magic, length = struct.unpack_from("<II", content, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + length
            if end > total:
                raise ValueError(f"skippable frame at {at} is cut")
            yield at, end, True
            at = end
            continue
        if magic != FRAME:
            raise ValueError(f"no frame at {at}")
        checksum = content[at + 4] >> 2 & 1
        end = at + zstd.frame_header_size(bytes(content[at : at + 18]))
        last = False
        while not last:
            if end + 3 > total:
                raise ValueError(f"frame at {at} is cut")
            head = int.from_bytes(content[end : end + 3], "little")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 * checksum
        if end > total:
            raise ValueError(f"frame at {at} is cut")
        yield at, end, False
        at = end


def parse_headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Header lines from `at` up to the empty line, names in lower case."""
    found: dict[str, str] = {}
    while not data.startswith(b"\r\n", at):
        m = HEADER.match(data, at)
        if m is None:
            raise ValueError(f"malformed header line at {at}")
        found[m[1].decode().lower()] = m[2].decode("utf-8", "replace")
        at = m.end()
    return found, at + 2


def parse_record(record: bytes) -> dict:
    """Fields of one record; ValueError when a header is missing, or a length or digest does not hold."""
    if not re.match(rb"WARC/1\.[01]\r\n", record):
        raise ValueError("no WARC version line")
    head, at = parse_headers(record, 10)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise ValueError(f"no {name}")
    if not head["content-length"].isdigit():
        raise ValueError("content-length is no number")
    length = int(head["content-length"])
    if len(record) != at + length + 4 or not record.endswith(b"\r\n\r\n"):
        raise ValueError(f"block of {len(record) - at - 4} bytes, {length} declared")
    kind, payload, size = head["warc-type"], record[at : at + length], length
    if kind in ("response", "revisit") and payload.startswith(b"HTTP/"):
        http, body = parse_headers(record, record.index(b"\r\n", at) + 2)
        payload = record[body : at + length]
        size = int(http.get("content-length", len(payload)))
        if kind == "response" and size != len(payload):
            raise ValueError(f"payload of {len(payload)} bytes, {size} declared")
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        if "warc-refers-to" not in head:
            raise ValueError("revisit without warc-refers-to")
    elif digest is not None and digest != digest32(payload):
        raise ValueError("payload digest does not hold")
    return {
        "record_id": head["warc-record-id"].strip("<>"),
        "record_type": kind,
        "target_uri": head.get("warc-target-uri"),
        "date": head["warc-date"],
        "payload_digest": digest,
        "payload_bytes": size,
        "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
        "payload": None if kind == "revisit" else payload,
    }


def read_frames(content: bytes) -> Iterator[tuple[int, dict]]:
    """(position, fields) of each record; a record that does not hold has only `error`, and a broken frame ends the archive."""
    view, decoder, position = memoryview(content), None, 0
    try:
        for begin, end, skippable in frames(view):
            if skippable:
                if begin == 0 and struct.unpack_from("<I", view)[0] == SKIPPABLE:
                    dictionary = bytes(view[8:end])
                    if dictionary[:4] == struct.pack("<I", FRAME):
                        dictionary = zstd.ZstdDecompressor().decompress(dictionary)
                    decoder = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(dictionary))
                continue
            decoder = decoder or zstd.ZstdDecompressor()
            try:
                record = decoder.decompressobj().decompress(view[begin:end])
                yield position, parse_record(record)
            except (ValueError, zstd.ZstdError) as error:
                yield position, {"error": str(error)}
            position += 1
    except ValueError as error:
        yield position, {"error": str(error)}


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the rows (archive, content); see RECORDS. Null or empty content has no record."""
    schema = RECORDS if payloads else RECORDS.replace("payload binary, ", "")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"position": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names)

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for position, fields in read_frames(content.as_py() or b""):
                    if not payloads:
                        fields.pop("payload", None)
                    rows.append({"archive": name, "position": position, **fields})
                    size += len(fields.get("payload") or b"") + 200
                    if size > 1 << 24:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return archives.select("archive", "content").mapInArrow(run, schema)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Archive files below `path` as rows (archive, content)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def with_first_copy(pages: DataFrame, id_column: str, payload: str, least_bytes: int) -> DataFrame:
    """Adds refers_to: the smallest id with an equal payload (SHA-256), null for that row itself and for short payloads."""
    keyed = pages.withColumn("_key", F.sha2(joined(payload), 256)).withColumn("_length", F.octet_length(joined(payload)))
    first = keyed.where(F.col("_length") >= least_bytes).groupBy("_key").agg(F.min(id_column).alias("_first"))
    first = first.withColumnRenamed("_key", "_same")
    out = keyed.join(first, F.col("_key") == F.col("_same"), "left")
    other = ~F.col(id_column).eqNullSafe(F.col("_first"))
    return out.withColumn("refers_to", F.when(other, F.col("_first"))).drop("_key", "_same", "_length", "_first")


def write_archives(
    pages: DataFrame,
    id_column: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = 1 << 21,
    sample_rows: int = 200,
    level: int = 3,
) -> DataFrame:
    """Archives (archive, content) with one record per row of `pages`, each of about `archive_bytes`.

    The dictionary is trained on at most `sample_rows` rows (those with the smallest id hash; up to 16 KB of each), which
    affects sizes only. Equal payloads of at least `least_bytes` bytes: the smallest id is the response, the others are
    revisits of it; rows equal in id and payload are all responses. Null payloads are empty, null urls leave the header
    out, null ids are written as `null` and refer to the smallest id if there is one. Other columns are ignored.
    """
    plain = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url).alias("url"), joined(payload).alias("payload"))
    chosen = plain.select(F.xxhash64("id").alias("h"), F.substring("payload", 1, 1 << 14).alias("p")).orderBy("h", "p").limit(sample_rows)
    dictionary = train_dictionary([record_bytes("urn:page:0", "http://", date, r.p.encode(), None) for r in chosen.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(archive: Archive) -> pa.RecordBatch:
            content = b"".join(archive.parts)
            name = hashlib.sha256(content).hexdigest()[:32] + ".warc.zst"
            return pa.record_batch([pa.array([name]), pa.array([content], pa.binary())], ["archive", "content"])

        archive = Archive(dictionary, level)
        for batch in batches:
            for i in range(batch.num_rows):
                page, link, body, first = (batch.column(c)[i].as_py() for c in range(4))
                name = "urn:page:null" if page is None else f"urn:page:{page}"
                archive.add(record_bytes(name, link, date, body.encode(), None if first is None else f"urn:page:{first}"))
                if archive.size >= archive_bytes:
                    yield row(archive)
                    archive = Archive(dictionary, level)
        if archive.records:
            yield row(archive)

    linked = with_first_copy(plain, "id", "payload", least_bytes).select("id", "url", "payload", "refers_to")
    return linked.mapInArrow(run, ARCHIVES)


def archived_pages(pages: DataFrame, **options) -> DataFrame:
    """Write all pages as archives in the shared folder, read these back and return a row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, error (null when the record holds).
    """
    archives = stored(write_archives(pages, **options), "archives")
    records = read_archives(archives, payloads=False)
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    return records.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
        "target_uri",
        "error",
    )
