"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent zstd frames, each holding whole records of about
``FRAME_BYTES``, and a last skippable frame with the seek table: compressed and raw size
of every frame, their number and a magic footer, as zstd's seekable format lays down.  Any
zstd tool reads a bundle as one stream; with the table a reader takes one frame alone.
The index maps each record identifier to its bundle, frame, and offset within the frame.

Records of equal payloads of ``REVISIT_BYTES`` or more are stored once: that of the largest
page id is a ``response``, the others are ``revisit`` records that refer to it.  Groups are
found from digests by an aggregate and an equi-join that adaptive execution can split, so a
payload that a third of all pages share costs no task more than its part.

Executors write straight to the folder that the cluster shares (``spark.checkpoint.dir``),
under names no other attempt uses; only bundles that the written index names are ever read,
so what a lost executor leaves half-written is never seen.

Defined results: null html is an empty payload and a null url an empty one; a null page id
sorts before all others, and of rows that tie for the largest page id each is a response;
repeated rows give a record each; line ends in urls are percent-encoded; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.text import small_batches
from docketry.session import Scratch

FRAME_BYTES, BUNDLE_BYTES, REVISIT_BYTES = 1 << 18, 64 << 20, 1000

#: Fixed values of the seekable format: skippable frame magic, footer magic.
_SKIP, _SEEK = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def _page_of(urn: str) -> int | None:
    found = urn[1:-1].split(":")[2]
    return int(found) if found else None


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit carries the payload's digest and length but no block."""
    safe = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {_PROFILE}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that begins at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:stop].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    n = int(headers["Content-Length"])
    block = data[stop + 4 : stop + 4 + n]
    if len(block) != n or data[stop + 4 + n : stop + 8 + n] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut short")
    return headers, block, stop + 8 + n


class BundleWriter:
    """Writes records to one bundle; ``add`` tells each record's frame and offset in it."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.raw, self.table, self.size = bytearray(), [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        if self.raw and len(self.raw) + len(data) > self.frame_bytes:
            self._flush()
        at = len(self.table), len(self.raw)
        self.raw += data
        return at

    def _flush(self) -> None:
        frame = self.zstd.compress(bytes(self.raw))
        self.out.write(frame)
        self.table.append((len(frame), len(self.raw)))
        self.size += len(frame)
        self.raw.clear()

    def close(self) -> None:
        if self.raw:
            self._flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, _SEEK)
        self.out.write(struct.pack("<II", _SKIP, len(body)) + body)
        self.out.close()


class BundleReader:
    """Reads frames of a bundle by way of its seek table; ``f`` has seek and read."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != _SEEK:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        f.seek(size - 9 - n * entry)
        table = f.read(n * entry)
        self.frames, at = [], 0
        for k in range(n):
            c, raw = struct.unpack_from("<II", table, k * entry)
            self.frames.append((at, c, raw))
            at += c

    def frame(self, k: int) -> bytes:
        at, c, raw = self.frames[k]
        self.f.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.f.read(c), max_output_size=raw)
        if len(data) != raw:
            raise ValueError(f"frame {k} holds {len(data)} bytes and not {raw}")
        return data

    def records(self) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
        """Frame, offset in it, headers and block of every record."""
        for k in range(len(self.frames)):
            data, at = self.frame(k), 0
            while at < len(data):
                headers, block, end = parse(data, at)
                yield k, at, headers, block
                at = end


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _open(uri: str) -> tuple[object, int]:
    system, path = _file_system(uri)
    f = system.open_input_file(path)
    return f, f.size()


def _written(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        task = TaskContext.get()
        writer, number, uri = None, 0, ""
        for batch in batches:
            out: list[tuple] = []
            for page, url, html, digest, refers in zip(*(batch.column(k) for k in range(5)), strict=True):
                if writer is None:
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
                    writer, uri = BundleWriter(system.open_output_stream(f"{path}/{name}", compression=None), frame_bytes), f"{folder}/{name}"
                    number += 1
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                to = refers.as_py() if refers.is_valid else None
                data = record(page.as_py(), url.as_py() or "", payload, digest.as_py(), to)
                frame, at = writer.add(data)
                out.append((record_id(page.as_py(), digest.as_py()), page.as_py(), uri, frame, at, len(data)))
                if writer.size >= bundle_bytes:
                    writer.close()
                    writer = None
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["record_id", "page_id", "bundle", "frame", "frame_offset", "length"])
        if writer is not None:
            writer.close()

    return run


def write_bundles(pages: DataFrame, folder: str, index_path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write an archive under ``folder`` (a URI that all executors reach) and return its index.

    The index (record_id, page_id, bundle, frame, frame_offset, length) is written as a
    table: it is the commit, and bundles that it doesn't name aren't part of the archive.
    """
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    groups = rows.where(F.col("n") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("of")).where("of > 1").select("digest", "first")
    joined = rows.join(groups, "digest", "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    refers = F.when(other, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(":"), F.col("digest"), F.lit(">")))
    full = joined.select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", refers.alias("refers"))
    index = full.mapInArrow(_written(folder, frame_bytes, bundle_bytes), "record_id string, page_id long, bundle string, frame int, frame_offset long, length long")
    path = index_path or f"{folder}/index"
    index.write.mode("overwrite").parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            f, size = _open(uri)
            with f:
                out: list[tuple] = []
                frame = 0
                for k, _, h, block in BundleReader(f, size).records():
                    if k != frame and out:
                        yield _records(out)
                        out, frame = [], k
                    out.append((h, block))
                if out:
                    yield _records(out)


def _records(rows: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
    digests = []
    for h, block in rows:
        told = h["WARC-Payload-Digest"].removeprefix("sha1:")
        if h["WARC-Type"] == "response" and (hashlib.sha1(block).hexdigest() != told or int(h["X-Payload-Length"]) != len(block)):
            raise ValueError(f"{h['WARC-Record-ID']} does not match its digest")
        digests.append(told)
    refers = [_page_of(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None for h, _ in rows]
    return pa.record_batch(
        [
            pa.array([_page_of(h["WARC-Record-ID"]) for h, _ in rows], pa.int64()),
            pa.array([h["WARC-Target-URI"] for h, _ in rows], pa.string()),
            pa.array([h["WARC-Type"] for h, _ in rows], pa.string()),
            pa.array(refers, pa.int64()),
            pa.array([int(h["X-Payload-Length"]) for h, _ in rows], pa.int64()),
            pa.array(digests, pa.string()),
            pa.array([b for _, b in rows], pa.binary()),
        ],
        names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"],
    )


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the archive, read back and held against its digest."""
    bundles = index.select("bundle").distinct()
    # by range, which deals out evenly: hashes leave some tasks empty, and a key that the
    # rows are already dealt by is left to adaptive execution, which puts all into one task
    bundles = bundles.repartitionByRange(max(1, min(10_000, bundles.count())), "bundle")
    return bundles.mapInArrow(_read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for uri, frame, at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            f, size = _open(uri)
            with f:
                headers, block, _ = parse(BundleReader(f, size).frame(frame), at)
            out.append((headers, block))
        if out:
            yield _records(out)


def fetch(index: DataFrame, record_ids: DataFrame) -> DataFrame:
    """Single records by identifier (column record_id): one frame is read for each."""
    rows = index.join(record_ids.select("record_id").distinct(), "record_id").select("bundle", "frame", "frame_offset")
    return rows.mapInArrow(_fetched, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def to_bytes(records: list[bytes], frame_bytes: int = FRAME_BYTES) -> bytes:
    """A bundle of the given records in memory."""
    out = io.BytesIO()
    out.close, data = lambda: None, out  # keep what was written
    w = BundleWriter(data, frame_bytes)
    for r in records:
        w.add(r)
    w.close()
    return data.getvalue()


def op3_warc_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as an archive in the shared folder and read back from it."""
    scratch = Scratch(spark, "warc")
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.path("bundles"))
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
