"""Zstandard WARC archives: writing, and a validating reader.

An archive is a skippable frame (magic 0x184D2A5D) with the dictionary,
itself a zstd frame, and then one frame for each record, compressed with that
dictionary and with its content size and checksum in its header. Archives
are made per task and closed at ``ARCHIVE_BYTES`` of payload; each has a
dictionary of its own, trained on at most ``SAMPLE_BYTES`` of the archive's
first pages, so nothing is gathered first. They are kept as rows (name, part, content)
of a Parquet table in the shared folder: executors write no files of their own,
and a lost task is written anew.

The reader loads the dictionary, walks the frames by their declared content
sizes, and checks the magic, the version line, the headers asked for
(WARC-Type, WARC-Record-ID, WARC-Date, Content-Length), that Content-Length is
what stands between header and the closing blank lines, and the payload's
digest. A record that fails gives a row with ``error`` and doesn't end the
archive, unless frames can't be told apart any more.

Defined results: null and empty payloads are empty records. A null url is written without
WARC-Target-URI. Rows that share a page_id are records of their own; of equal
payloads the smallest page_id (each of its rows, where it is repeated) is a
response. A row whose page_id is null is a response. Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm._scratch import Scratch, bounded
from framelake.sources._bytes import open_at, seekable

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
ARCHIVE_BYTES = 4 << 20
SAMPLE_BYTES = 512 << 10
DICTIONARY_BYTES = 16 << 10
#: Of a foreign archive's dictionary, at most.
MOST_DICTIONARY = 64 << 20
_STEP = 1 << 16
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive or record that isn't well formed."""


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, length: int, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record; a revisit has headers alone and tells the payload's length."""
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    head += [f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {length}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    body = b"" if revisit else payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def archive(records: list[bytes], level: int = 3) -> bytes:
    """The bytes of one archive."""
    samples, size = [], 0
    for r in records:
        if size + len(r) <= SAMPLE_BYTES:
            samples.append(r)
            size += len(r)
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        trained = b""
    if not trained:  # too little to learn from: any bytes make a dictionary of raw content
        trained = b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n"
    packed = zstandard.ZstdCompressor(level=9).compress(trained)
    out = [DICTIONARY_MAGIC.to_bytes(4, "little"), len(packed).to_bytes(4, "little"), packed]
    encoder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True, write_content_size=True)
    out += [encoder.compress(r) for r in records]
    return b"".join(out)


def frames(content) -> Iterator[bytes | WarcError]:
    """The records of an archive (bytes, or a file that is read as it goes), one for each frame."""
    file = io.BytesIO(content) if isinstance(content, bytes) else content
    head = file.read(8)
    if len(head) < 8 or int.from_bytes(head[:4], "little") != DICTIONARY_MAGIC:
        raise WarcError("no dictionary frame at the beginning")
    size = int.from_bytes(head[4:], "little")
    if size > MOST_DICTIONARY:
        raise WarcError(f"a dictionary frame of {size} bytes")
    raw = file.read(size)
    if len(raw) < size:
        raise WarcError("the dictionary frame is cut off")
    if raw[:4] == FRAME_MAGIC.to_bytes(4, "little"):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    held, at = file.read(_STEP), 8 + size
    while held:
        if len(held) < 18:  # what a frame's header takes at most
            held += file.read(_STEP)
        if int.from_bytes(held[:4], "little") != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        one = decoder.decompressobj()
        told = zstandard.frame_content_size(held[:18])
        parts, used = [], 0
        try:
            while True:
                parts.append(one.decompress(held))
                used += len(held)
                if one.eof:
                    break
                held = file.read(_STEP)
                if not held:
                    raise WarcError("the last frame is cut off")
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {at}: {e}") from e
        held = one.unused_data
        at += used - len(held)
        found = b"".join(parts)
        yield found if told in (-1, len(found)) else WarcError(f"a frame of {len(found)} bytes that tells {told}")
        if not held:
            held = file.read(_STEP)


def _number(text: str) -> int | None:
    """A header's number: ASCII digits alone, no more than lengths have."""
    return int(text) if re.fullmatch("[0-9]{1,18}", text) else None


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and content of a record, checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError("no version line or no end of the headers")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"a header that isn't one: {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"no {name}")
    if _number(fields["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {fields['content-length']}; {len(rest) - 4} bytes stand there")
    body = rest[:-4]
    if fields["warc-type"] == "response" and fields.get("warc-payload-digest", "") != f"sha1:{digest(body)}":
        raise WarcError("the payload's digest is another")
    return fields, body


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives (name, content, records) of all rows of ``pages``.

    Of records with equal payloads of at least ``least`` bytes, the one with
    the smallest page_id is a response and the others revisit it.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("sha", F.unhex(F.sha1(payload)))
    seen = rows.where("page_id IS NOT NULL").where(F.length(payload) >= least).select("page_id", "sha")
    # a row for each payload that comes more than once, combined before the shuffle
    again = seen.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("sha", "first")
    scratch = Scratch(pages.sparkSession)
    # pages meet their revisit by page_id, so equal payloads don't gather in a task
    revisits = scratch.keep(seen.join(again, "sha").where("page_id > first").select("page_id", "sha", "first").distinct()).df
    return scratch.keep(
        rows.join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "html", "first").mapInArrow(_archives, "name string, content binary, records long")
    ).df


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = 0

    def close() -> pa.RecordBatch:
        content = archive(held)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([f"pages-{hashlib.sha256(content).hexdigest()[:24]}.warc.zst"]), pa.array([content], pa.binary()),
                pa.array([len(held)], pa.int64())
            ],
            ["name", "content", "records"]
        )

    for batch in batches:
        for page_id, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
            payload = (html or "").encode()
            held.append(record(page_id, url, payload, digest(payload), len(payload), first, first is not None))
            size += len(payload)
            if size >= ARCHIVE_BYTES:
                yield close()
                held, size = [], 0
    if held:
        yield close()


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string, archive string, error string"


def _page(fields: dict[str, str], name: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", fields.get(name, ""))
    return int(m[1]) if m and -(1 << 63) <= int(m[1]) < 1 << 63 else None


def _rows(name: str, content, with_payload: bool) -> Iterator[tuple]:
    """What each record of an archive gives, one at a time."""
    try:
        for raw in frames(content):
            try:
                if isinstance(raw, WarcError):
                    raise raw
                fields, body = parse(raw)
                revisit = fields["warc-type"] == "revisit"
                size = _number(fields["x-payload-length"]) if "x-payload-length" in fields else len(body)
                if size is None or not revisit and size != len(body):
                    raise WarcError(f"X-Payload-Length is {size}; the payload has {len(body)} bytes")
                yield _page(fields, "warc-record-id"), size, fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields["warc-type"], _page(fields, "warc-refers-to"), fields.get("warc-target-uri"), None if revisit or not with_payload else body.decode(), name, None
            except (WarcError, UnicodeDecodeError) as e:
                yield None, None, None, None, None, None, None, name, str(e)
    except (WarcError, zstandard.ZstdError) as e:
        yield None, None, None, None, None, None, None, name, str(e)


def _told(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``ARCHIVE_BYTES`` of payload at most."""
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in READ.split(", ")]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[6] or "") + 100
        if size >= ARCHIVE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of archives (name, content), validated; ``error`` tells what is wrong with one."""
    bounded(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                yield from _told(_rows(name, content.as_py() or b"", with_payload))

    return archives.select("name", "content").mapInArrow(run, READ)


def read_files(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The same of archive files, one task each, read as they go; of stores that Spark alone knows, whole."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if not seekable(path):
        return read(found.select(F.col("path").alias("name"), "content"), with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with open_at(name) as f:
                    yield from _told(_rows(name, f, with_payload))

    return found.select("path").repartition("path").mapInArrow(run, READ)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """What the archives of ``pages`` hold, read back; a damaged record fails the query."""
    found = read(write(pages, least), with_payload=False)
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("record_type"))
    return found.select("page_id", "payload_bytes", "payload_digest", checked.cast("string").alias("record_type"), "refers_to")
