"""WARC archives in seekable Zstandard bundles, with revisit records for repeated payloads."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.llm.text import hot_limit
from gridfolio.session import scratch_path, written

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Uncompressed bytes after which a frame, and a bundle, is closed. A record is never split.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
#: Repeated payloads whose keys may be broadcast, about 80 bytes each; more are joined by a shuffle.
BROADCAST_PAYLOADS = 500_000
#: Fixed values of the seekable format and of the revisit profile.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "page_id long, bundle string, frame int, frame_offset long, frame_bytes long, record_offset long, record_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _filesystem(uri: str):
    """The file system of a shared folder and the path in it; executors write through it, never to a disk of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record. A revisit has the headers of the response, the digest and length of the payload, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """The records of an uncompressed frame: offset, bytes, headers by lower-case name, block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        yield at, end + 4 + size + 4 - at, headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


class BundleWriter:
    """Collects records in independent frames and appends a seek table that Zstandard readers skip."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[bytes, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.total = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset within the uncompressed frame."""
        if self.open and self.open_bytes + len(data) > self.frame_bytes:
            self._close()
        place = len(self.frames), self.open_bytes
        self.open.append(data)
        self.open_bytes += len(data)
        self.total += len(data)
        return place

    def _close(self) -> None:
        self.frames.append((self.compressor.compress(b"".join(self.open)), self.open_bytes))
        self.open, self.open_bytes = [], 0

    def finish(self) -> tuple[bytes, list[tuple[int, int]]]:
        """The bundle, and offset and size of each compressed frame."""
        if self.open:
            self._close()
        table = b"".join(struct.pack("<II", len(c), n) for c, n in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        places, at = [], 0
        for c, _ in self.frames:
            places.append((at, len(c)))
            at += len(c)
        return b"".join(c for c, _ in self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table, places


def seek_table(source) -> list[tuple[int, int, int]]:
    """Offset, compressed and uncompressed size of each frame, from the end of a seekable file object."""
    size = source.size()
    source.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the bundle has no seek table")
    width = 12 if flags & 0x80 else 8
    source.seek(size - 9 - count * width)
    raw, out, at = source.read(count * width), [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", raw, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write every row of ``pages`` as a record to bundles under ``folder``; returns the manifest, one row per record.

    Of equal payloads of at least REVISIT_BYTES bytes the row with the largest id is the response and the others
    are revisits of it; smaller payloads are always responses. A null html is an empty payload. Rows that repeat
    the winning id are each a response. With only null ids in a group all of it are responses.

    A bundle's name is new for each attempt of a task, and the manifest names those of the attempts that counted,
    so that a task that runs twice leaves an orphan file but no record twice.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    size = F.octet_length(html).cast("long")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), size.alias("size"), F.sha1(html.cast("binary")).alias("digest")
    )
    # Small payloads need no winner, so they are neither grouped nor shuffled: empty pages may be a third of all.
    small = rows.where(F.octet_length("html") < REVISIT_BYTES).withColumn("refers_to", F.lit(None).cast("long"))
    large = rows.where(F.octet_length("html") >= REVISIT_BYTES).withColumn("second", F.xxhash64("html"))
    key = ["digest", "size", "second"]
    marked = written(large.select("page_id", F.struct(*key).alias("key")).groupBy("key").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "payloads")
    # Only payloads that recur are named, the html itself stays where it was read; a payload that doesn't recur refers to nothing.
    repeated = marked.select(F.col("key.*"), "first")
    few = marked.count() <= BROADCAST_PAYLOADS
    if few:
        named = large.join(F.broadcast(repeated), key, "left")
    else:
        # Payloads with very many copies are few and stay where they are; the others are joined by a shuffle.
        hot = F.broadcast(marked.where(F.col("n") > hot_limit(marked.agg(F.sum("n")).first()[0])).select(F.col("key.*"), "first"))
        named = large.join(hot, key).unionByName(large.join(hot.select(*key), key, "left_anti").join(repeated, key, "left"))
    named = named.withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    columns = ["page_id", "url", "html", "digest", "refers_to"]
    named = small.select(*columns).unionByName(named.select(*columns))

    def run(batches):
        filesystem, path = _filesystem(folder)
        filesystem.create_dir(path, recursive=True)
        bundle, entries = BundleWriter(), []

        def flush():
            nonlocal bundle, entries
            name = f"{uuid.uuid4().hex}.warc.zst"
            data, places = bundle.finish()
            with filesystem.open_output_stream(f"{path}/{name}.part") as out:
                out.write(data)
            filesystem.move(f"{path}/{name}.part", f"{path}/{name}")
            out = pd.DataFrame([(i, f"{folder}/{name}", f, *places[f], at, n) for i, f, at, n in entries], columns=[x.split()[0] for x in MANIFEST.split(", ")])
            bundle, entries = BundleWriter(), []
            return out.astype({"page_id": "Int64"})

        for pdf in batches:
            ids, refers = pdf["page_id"].astype("Int64"), pdf["refers_to"].astype("Int64")
            for page_id, url, text, digest, to in zip(ids, pdf["url"], pdf["html"], pdf["digest"], refers, strict=True):
                page_id, to = None if pd.isna(page_id) else int(page_id), None if pd.isna(to) else int(to)
                data = record(page_id, url, text.encode(), digest, to)
                entries.append((page_id, *bundle.add(data), len(data)))
                if bundle.total >= bundle_bytes:
                    yield flush()
        if entries:
            yield flush()

    return written(named.mapInPandas(run, MANIFEST), "manifest")


def _row(headers: dict[str, str], block: bytes) -> tuple:
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["warc-payload-length"])
    if headers["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
        raise ValueError(f"payload of {headers['warc-record-id']} doesn't match its digest")
    return number(headers["warc-record-id"]), headers.get("warc-target-uri"), size, digest, headers["warc-type"], number(headers.get("warc-refers-to", ""))


def read_archives(manifest: DataFrame) -> DataFrame:
    """All records of the bundles that a manifest names, read by their seek tables, one frame in memory at a time.

    The payload of a response is hashed again and must match its recorded digest; a revisit carries the digest
    and length of the payload that it refers to.
    """
    bundles = written(manifest.select("bundle").distinct(), "bundles")
    # As many tasks as bundles: otherwise so small a table would be read by a single one.
    bundles = bundles.repartition(max(1, min(bundles.count(), 10_000)))

    def run(batches):
        for pdf in batches:
            for name in pdf["bundle"]:
                filesystem, path = _filesystem(name)
                with filesystem.open_input_file(path) as source:
                    for at, packed, plain in seek_table(source):
                        source.seek(at)
                        data = zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=plain)
                        out = [_row(headers, block) for _, _, headers, block in parse(data)]
                        yield pd.DataFrame(out, columns=[x.split()[0] for x in RECORDS.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return bundles.mapInPandas(run, RECORDS)


def fetch(manifest: DataFrame, page_id: int) -> list[bytes]:
    """The payloads stored for one page, each by reading only the frame that the manifest points to."""
    out = []
    for r in manifest.where(F.col("page_id") == page_id).toLocalIterator():
        filesystem, path = _filesystem(r["bundle"])
        with filesystem.open_input_file(path) as source:
            source.seek(r["frame_offset"])
            data = zstandard.ZstdDecompressor().decompressobj().decompress(source.read(r["frame_bytes"]))
        own = data[r["record_offset"] : r["record_offset"] + r["record_bytes"]]
        block = next(parse(own))[3]
        out.append(block[block.index(b"\r\n\r\n") + 4 :])
    return out


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
