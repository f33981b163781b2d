"""WARC archives with one Zstandard frame per record and a leading dictionary frame.

Archives are rows of a table, so that Spark's own commit makes lost tasks harmless. The
reader loads the dictionary from the leading skippable frame, walks the frames by their
block headers, decodes one frame per record and checks headers, lengths and digests.

Defined results: null payloads are empty; of equal payloads one record with the largest id
is the response and the others revisit it, also where rows are repeated (of equal ids one
is taken); a null id is written as an empty one, read back as null, and smaller than all;
payloads of any length are written whole; broken archives raise ``ValueError``; an empty
table gives no archive; only id, address and text are read, whatever the other columns'
names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, perhaps_in, table

DICT_MAGIC, DICT_BYTES, ARCHIVE_BYTES = 0x184D2A5D, 65_536, 16 << 20


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    return int(name[10:-1]) if name[10:-1] else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    kind = "revisit" if revisit else "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{_digest(payload)}", f"WARC-Block-Digest: sha1:{_digest(block)}"]
    if revisit:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    raw = b"".join(r[:4096] for r in records[:64])[-DICT_BYTES:]
    words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    writer = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True, write_content_size=True)
    return struct.pack("<II", DICT_MAGIC, len(raw)) + raw + b"".join(writer.compress(r) for r in records)


def _frame_end(data: bytes, at: int) -> int:
    head = data[at : at + 18]
    params = zstandard.get_frame_parameters(head)
    at += zstandard.frame_header_size(head)
    while True:
        b = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if b >> 1 & 3 == 1 else b >> 3)
        if at > len(data):
            raise ValueError("frame ends early")
        if b & 1:
            return at + 4 * params.has_checksum


def unpack(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, checked."""
    try:
        yield from _unpack(data)
    except (zstandard.ZstdError, struct.error, KeyError) as e:
        raise ValueError(f"broken archive: {e}") from e


def _unpack(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    magic, size = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC or 8 + size > len(data):
        raise ValueError("no dictionary frame")
    raw = data[8 : 8 + size]
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        raw = zstandard.ZstdDecompressor().decompress(raw)
    mode = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=mode))
    at = 8 + size
    while at < len(data):
        end = _frame_end(data, at)
        text = reader.decompress(data[at:end])
        at = end
        head, sep, rest = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not sep or not lines[0].startswith("WARC/1."):
            raise ValueError("not a record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        n = int(headers["content-length"])
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise ValueError("length of a record does not fit")
        block = rest[:n]
        if headers["warc-block-digest"] != f"sha1:{_digest(block)}":
            raise ValueError("digest of a record does not fit")
        yield headers, block


def write(df: DataFrame) -> DataFrame:
    """(archive) rows from (page_id, url, payload, refers_to, revisit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for p, u, h, r, v in zip(*batch.columns, strict=True):
                one = record(p.as_py(), u.as_py(), h.as_py() or b"", r.as_py(), v.as_py())
                held.append(one)
                size += len(one)
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([pack(held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pack(held)], pa.binary())], ["archive"])

    return df.select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(run, "archive binary")


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, and if asked for payload (null for revisits)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                for h, block in unpack(data.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    n = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    digest = h["warc-payload-digest"].partition(":")[2]
                    kind = h["warc-type"]
                    if kind == "response" and (len(payload) != n or _digest(payload) != digest):
                        raise ValueError("payload does not fit its headers")
                    rows.append((_number(h["warc-record-id"]), n, digest, kind, _number(h.get("warc-refers-to", "")), payload if with_payload and kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return archives.mapInArrow(run, schema)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0) -> DataFrame:
    """Write every page and give the archives; payloads under ``least`` bytes are never revisits."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"))
    rows = cut(rows.withColumn("d", F.unhex(F.sha1("payload"))).withColumn("row", F.monotonically_increasing_id()))
    slim = rows.where(F.octet_length("payload") >= least).select("row", "page_id", "d")
    heads = slim.groupBy("d").agg(F.max(F.struct("page_id", "row")).alias("h"), F.count("*").alias("k")).where("k > 1").select("d", "h")
    # A very common payload meets its head without its bytes, and rows that surely are responses are not shuffled at all.
    again = cut(slim.join(heads, "d").where("row <> h.row").select("row", F.col("h.page_id").alias("refers_to")))
    marked = perhaps_in(rows.drop("d"), "row", again.select("row"), again.count(), "maybe")
    sure = marked.where("not maybe").select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    other = marked.where("maybe").join(again.withColumn("revisit", F.lit(True)), "row", "left")
    other = other.select("page_id", "url", "payload", "refers_to", F.coalesce("revisit", F.lit(False)).alias("revisit"))
    out = cut(write(sure.unionByName(other)))
    drop(rows, again)
    return out


def op9(spark, sf_dir):
    return read(archive(table(spark, sf_dir, "pages")), with_payload=False)
