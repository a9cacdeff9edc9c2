"""WARC archives with one Zstandard frame per record and a dictionary in front."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceframe.llm.common import prepare

# Fixed values of the formats: skippable frame that holds the dictionary, ordinary frame,
# and an empty skippable frame, which Spark's text writer puts after every row.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
SPACER = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-record:"
RECORD = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload binary, payload_bytes long, payload_digest string, error string"


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A Zstandard dictionary; with too few samples, their plain start serves as one."""
    plain = b"".join(samples)[:size]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return plain or b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: HTTP/1.1 200 OK\r\n"


def build_record(record_id: str, uri: str | None, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record: a response with its payload, or a revisit that names the response."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <{ID_PREFIX}{record_id}>",
        f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(body)}",
    ]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def headers(block: bytes) -> tuple[str, dict[str, str], int]:
    """First line, fields with lower-case names, and where the body starts."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("headers do not end")
    first, *rest = block[:end].decode("utf-8").split("\r\n")
    fields = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header without a colon: {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    return first, fields, end + 4


def _id(value: str) -> str:
    if not value.startswith(f"<{ID_PREFIX}") or not value.endswith(">"):
        raise ValueError(f"unknown record id {value[:60]!r}")
    return value[len(ID_PREFIX) + 1 : -1]


def parse_record(record: bytes) -> dict:
    """Fields of a record after checking version, headers, lengths and digest."""
    version, fields, start = headers(record)
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"version {version[:20]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    length = int(fields["content-length"])
    if len(record) != start + length + 4 or record[start + length :] != b"\r\n\r\n":
        raise ValueError(f"record of {len(record)} bytes does not hold {length} of content")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise ValueError(f"type {kind[:20]!r}")
    status, http, body = headers(record[start : start + length])
    if not status.startswith("HTTP/"):
        raise ValueError("content is no HTTP message")
    payload = record[start + body : start + length]
    size = int(http.get("content-length", len(payload)))
    digest = fields.get("warc-payload-digest", "")
    if not digest.startswith("sha1:"):
        raise ValueError("no payload digest")
    digest = digest[5:]
    refers = None
    if kind == "response":
        if size != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError("payload does not fit its length or digest")
    else:
        if payload or "warc-refers-to" not in fields:
            raise ValueError("revisit with a payload or without a reference")
        refers = _id(fields["warc-refers-to"])
    uri = fields.get("warc-target-uri")
    if uri is not None:
        uri = uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {
        "record_id": _id(fields["warc-record-id"]), "record_type": kind, "target_uri": uri, "warc_date": fields["warc-date"],
        "refers_to": refers, "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "error": None,
    }


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its block headers."""
    at_block = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    checksum = zstandard.get_frame_parameters(bytes(data[at : at + 18])).has_checksum
    last = False
    while not last:
        if at_block + 3 > len(data):
            raise ValueError("frame is cut off")
        head = int.from_bytes(data[at_block : at_block + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        at_block += 3 + (1 if kind == 1 else size)
    end = at_block + 4 * checksum
    if end > len(data):
        raise ValueError("frame is cut off")
    return end


def read_archive(content: bytes) -> Iterator[dict]:
    """Records of one archive; damage gives a row with ``error`` and ends or skips the frame."""
    blank = dict.fromkeys(x.split()[0] for x in RECORD.split(", "))
    data, at, plain = memoryview(content), 0, None
    try:
        while at < len(data):
            if at + 8 > len(data):
                raise ValueError("frame is cut off")
            magic, size = struct.unpack_from("<II", data, at)
            if magic in SKIPPABLE:
                if at + 8 + size > len(data):
                    raise ValueError("skippable frame is cut off")
                if at == 0 and magic == DICTIONARY_MAGIC:
                    stored = bytes(data[8 : 8 + size])
                    if stored[:4] == FRAME_MAGIC.to_bytes(4, "little"):
                        stored = zstandard.ZstdDecompressor().decompress(stored)
                    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored))
                at += 8 + size
                continue
            if magic != FRAME_MAGIC:
                raise ValueError(f"no frame at byte {at}")
            if plain is None:
                plain = zstandard.ZstdDecompressor()
            end = frame_end(data, at)
            try:
                yield parse_record(plain.decompress(data[at:end]))
            except (ValueError, zstandard.ZstdError) as e:
                yield blank | {"error": f"frame at byte {at}: {e}"}
            at = end
    except (ValueError, zstandard.ZstdError) as e:
        yield blank | {"error": str(e)}


def revisits(pages: DataFrame, *, id: str, payload: str, least_bytes: int) -> DataFrame:
    """(id, digest, response): rows whose payload a smaller id has as well.

    Only ids and digests are shuffled; counts are added up before the shuffle, so one
    payload with a third of the rows sends a row per task.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.filter(F.length(body) >= least_bytes).select(F.col(id).alias("id"), F.sha1(body).alias("digest"))
    firsts = rows.groupBy("digest").agg(F.min("id").alias("response"), F.max("id").alias("last")).filter("last > response").drop("last")
    return rows.join(firsts, "digest").filter("id > response").select("id", "digest", "response").distinct()


def write_warc(
    pages: DataFrame, path: str, *, id: str = "page_id", uri: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z",
    least_bytes: int = 0, records_per_archive: int = 4000, sample_rows: int = 400, sample_chars: int = 8192, dictionary_bytes: int = 65536, level: int = 6,
) -> None:
    """Write one record per row under ``path``, as archives of at most ``records_per_archive`` records.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the smallest
    id is a response and the others are revisits; rows that share that id are all responses,
    and so are rows with a null id.  A null payload is empty, a null uri is left out.  The dictionary
    is trained on the starts of ``sample_rows`` rows (that bound is its only use of a sample).
    Each archive starts with the dictionary in a skippable frame; every record is a frame
    of its own.  Spark's text writer puts them into the folder, with an empty skippable frame
    after each row, so archives can be in any store Spark writes to.
    """
    prepare(pages.sparkSession)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    # The rows of the smallest hashes: hashes alone are sorted, then the texts of the chosen ones are read.
    hashed = pages.select(F.xxhash64(id, payload).alias("h"), F.substring(payload, 1, sample_chars).alias("s"))
    chosen = [r.h for r in hashed.select("h").orderBy("h").limit(sample_rows).collect()]
    sample = hashed.filter(F.col("h") <= chosen[-1]).groupBy("h").agg(F.min("s").alias("s")).orderBy("h").collect() if chosen else []
    dictionary = train_dictionary([r.s.encode() for r in sample if r.s], dictionary_bytes)
    again = revisits(pages, id=id, payload=payload, least_bytes=least_bytes).withColumnsRenamed({"id": "__id", "digest": "__digest", "response": "__response"})
    rows = pages.select(F.col(id).alias("id"), F.col(uri).alias("uri"), body.alias("body"), F.sha1(body).alias("digest"))
    rows = rows.join(again, (F.col("id") == F.col("__id")) & (F.col("digest") == F.col("__digest")), "left").select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "uri", "body", F.col("__response").cast("string").alias("response")
    )

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        done = 0
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                if done % records_per_archive == 0:
                    out.append(first)
                key, where, content, response = (batch.column(k)[i].as_py() for k in range(4))
                out.append(pack.compress(build_record(key, where, date, content, response)))
                done += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    packed = rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    packed.write.option("lineSep", SPACER).option("maxRecordsPerFile", records_per_archive + 1).option("compression", "none").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path``: ids, type, payload, its length and digest, reference and error.

    Version, mandatory headers, lengths and digests are checked; a bad record gives a row
    with ``error`` and nulls, a cut-off archive its good records and one such row.
    """
    prepare(spark)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
        kind = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for record in read_archive(content.as_py()):
                    rows.append(record)
                    held += len(record["payload"] or b"") + 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, RECORD)
