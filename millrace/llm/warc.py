"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

An archive starts with a skippable frame (magic 0x184D2A5D) whose content is the
dictionary, itself compressed or not; then each record is one frame. The reader
loads the dictionary, decodes frame by frame, and validates version, header
lines, block and payload lengths, the end of the record and the digest. A broken
archive raises ``WarcError`` with the byte position.

Archives are rows (name, content) of at most about ``ARCHIVE_BYTES``: Spark has
no writer for raw files, and a cluster's store may be open to Spark alone.
``read_files`` reads the same archives as files; ``export_files`` makes them
where the folder is local.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, slices, staged

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

URN = "urn:millrace:page:"
ARCHIVE_BYTES = 4 << 20
#: A dictionary is trained on the first payloads of a task: at most so many, so many bytes of each.
DICTIONARY_SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 150, 16_384, 16_384
LEVEL = 3
#: Payloads under this size are never revisits.
REVISIT_BYTES = 1000


class WarcError(ValueError):
    pass


def train(payloads: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from sample payloads; None if they are too few or too small."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads, level=LEVEL)
    except zstandard.ZstdError:
        return None


def leading_frame(dictionary: zstandard.ZstdCompressionDict | None) -> bytes:
    if dictionary is None:
        return b""
    content = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
    return struct.pack("<II", SKIPPABLE, len(content)) + content


def header_value(text: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response record, or a revisit that carries only the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {header_value(url) if url else URN}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return VERSION + "\r\n".join(lines).encode() + END + block + END


def decode_frames(archive: bytes) -> Iterator[tuple[int, bytes]]:
    """(position, content) of each frame after the leading one, under the archive's dictionary."""
    at, dictionary = 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == SKIPPABLE:
        at = 8 + struct.unpack_from("<I", archive, 4)[0]
        content = archive[8:at]
        if len(content) != at - 8:
            raise WarcError("the dictionary's frame is cut short")
        if content.startswith(FRAME_MAGIC):
            content = zstandard.ZstdDecompressor().decompress(content)
        dictionary = zstandard.ZstdCompressionDict(content)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(archive)
    step = 4096
    while at < len(archive):
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        one, out, to = reader.decompressobj(), [], at
        while not one.eof:
            if to >= len(archive):
                raise WarcError(f"the frame at byte {at} is cut short")
            fed = view[to : to + step]
            try:
                out.append(one.decompress(fed))
            except zstandard.ZstdError as e:
                raise WarcError(f"the frame at byte {at}: {e}") from None
            to += len(fed)
        yield at, b"".join(out)
        at = to - len(one.unused_data)


def parse(content: bytes, at: int = 0) -> dict:
    """A record's fields, after validation."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise WarcError(f"the record at byte {at}: {what}")

    need(content.startswith(VERSION), "no version line")
    head, sep, rest = content[len(VERSION) :].partition(END)
    need(bool(sep), "the header has no end")
    fields = {}
    for line in head.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        need(bool(colon) and name.strip() == name and bool(name), f"bad header line {line[:60]!r}")
        need(name.lower() not in fields, f"{name} repeats")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        need(name in fields, f"{name} is missing")
    need(fields["content-length"].isdigit(), "bad Content-Length")
    length = int(fields["content-length"])
    need(len(rest) == length + len(END) and rest.endswith(END), f"the block has {len(rest) - len(END)} bytes, not {length}")
    http, sep, payload = rest[:length].partition(END)
    need(bool(sep), "the HTTP header has no end")
    said = [int(v) for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")) if k.lower() == "content-length"]
    need(len(said) == 1, "the HTTP header has no single Content-Length")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    number = lambda key: int(v) if (v := fields[key].removeprefix(f"<{URN}").removesuffix(">")) else None
    if kind == "response":
        need(len(payload) == said[0], f"the payload has {len(payload)} bytes, not {said[0]}")
        need(hashlib.sha1(payload).hexdigest() == digest, "the digest differs")
    else:
        need(kind == "revisit" and not payload and "warc-refers-to" in fields, "neither a response nor a revisit")
    return {"page_id": number("warc-record-id"), "payload_bytes": said[0], "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to") if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` (payload), ``digest, refers_to``; refers_to is null for responses.

    Payloads are matched by SHA-256 and length, not by the SHA-1 that the records
    carry, for which unequal payloads of one digest can be made. The table of
    repeated payloads is broadcast only while small; only it, with one row per
    payload, is grouped.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("digest", F.sha1("text")).withColumn("same", F.when(F.length("text") >= REVISIT_BYTES, F.concat(F.sha2("text", 256), F.lit(":"), F.length("text").cast("string"))))
    repeated = cut(rows.filter("same is not null").groupBy("same").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1 and keep is not null").select(F.col("same").alias("d"), "keep"))
    met = rows.join(broadcast_if_small(repeated, F.lit(96)), F.col("same") == F.col("d"), "left")
    return met.select("page_id", "url", "text", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to"))


def write_archives(rows: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives (name, content) of the rows of ``with_revisits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, parts, size, compressor = TaskContext.get().partitionId(), 0, [], 0, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"name": [f"part-{part:06d}-{k:06d}.warc.zst"], "content": [b"".join(parts)]}, schema=pa.schema([("name", pa.string()), ("content", pa.binary())]))

        for batch in slices(batches):
            page = batch.to_pydict()
            if compressor is None:
                dictionary = train([p[:SAMPLE_BYTES] for p in page["text"][:DICTIONARY_SAMPLES]])
                lead = leading_frame(dictionary)
                compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
                parts, size = [lead], len(lead)
            for page_id, url, payload, digest, refers_to in zip(page["page_id"], page["url"], page["text"], page["digest"], page["refers_to"]):
                frame = compressor.compress(record(page_id, url, payload, digest, refers_to, refers_to is not None, date))
                parts.append(frame)
                size += len(frame)
                if size >= ARCHIVE_BYTES:
                    yield out()
                    parts, size, k = [lead], len(lead), k + 1
        if len(parts) > 1:
            yield out()

    return rows.mapInArrow(run, "name string, content binary")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives in column ``content``."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                got = [parse(content, at) for at, content in decode_frames(batch.column("content")[i].as_py())]
                yield pa.RecordBatch.from_pydict({n: [r[n] for r in got] for n in names}, schema=schema)

    return archives.select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def export_files(archives: DataFrame, folder: str) -> list[str]:
    """Writes the archives as files of a local folder, one at a time; for small exports and tests."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for r in archives.toLocalIterator():
        out.append(os.path.join(folder, r["name"]))
        with open(out[-1], "wb") as f:
            f.write(r["content"])
    return out


def read_files(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record of the ``.warc.zst`` files under ``path``."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content"), with_payload)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per page, then reads the archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Of equal payloads of at least ``REVISIT_BYTES`` the page with the largest id
    is the response and the others revisit it. Defined cases: null html is the
    empty payload; a null url becomes a placeholder; pages without an id get a
    record with an empty id and are responses unless a page with an id has
    their payload; rows that repeat the response's id are responses too; an
    empty table makes no archive; extra columns are ignored.
    """
    return read_archives(staged(write_archives(with_revisits(pages, id_col, url_col, html_col)), "warc"))
