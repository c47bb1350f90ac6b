"""WARC archives as seekable Zstandard bundles: independent frames, a seek table at the end, and an index by record."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import rows_to_batches, small_batches, table
from tessella.scratch import new_path, stored

#: Fixed values of the published seekable format: the magic numbers of a skippable frame and of the seek table's footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame and of frames in a bundle, before which a new one is begun.
FRAME, BUNDLE = 256 << 10, 64 << 20
#: Bytes of records that a task reads back, and neighbouring frames that go to one task.
READ, SLICE = 64 << 20, 64
#: Payloads of fewer bytes are always stored.
LEAST = 100


class Record(NamedTuple):
    page_id: int | None
    kind: str
    url: str
    digest: str
    payload: bytes
    payload_bytes: int
    refers_to: int | None


def record_bytes(r: Record) -> bytes:
    """A WARC/1.1 record. A revisit's block is the HTTP head alone; its payload's length stands in that head."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n".encode()
    block = head + (r.payload if r.kind == "response" else b"")
    url = "".join(r.url.split())
    lines = [
        "WARC/1.1", f"WARC-Type: {r.kind}", f"WARC-Record-ID: <{_name(r.page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {url}"] if url else []), f"WARC-Payload-Digest: sha256:{r.digest}",
    ]
    if r.kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_name(r.refers_to)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return "urn:x-page:" + ("" if page_id is None else str(page_id))


def _id(name: str) -> int | None:
    number = name.strip("<> ").rpartition(":")[2]
    return int(number) if number else None


def parse_records(data: bytes) -> Iterator[tuple[int, int, Record]]:
    """Offset, length and content of each record of a decompressed frame. Raises ValueError on a damaged one."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = data[end + 4 : end + 4 + int(head["content-length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest, kind = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"the payload at byte {at} differs from its digest")
        stop = end + 4 + len(block) + 4
        refers = _id(head["warc-refers-to"]) if "warc-refers-to" in head else None
        yield at, stop - at, Record(_id(head["warc-record-id"]), kind, head.get("warc-target-uri", ""), digest, payload, size, refers)
        at = stop


def _filesystem(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class BundleWriter:
    """Writes frames to one file and the seek table at its end."""

    def __init__(self, folder: str, level: int = 3):
        import zstandard

        self.name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.fs, path = _filesystem(self.name)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(path, compression=None)
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.sizes: list[tuple[int, int]] = []
        self.written = 0

    def frame(self, data: bytes) -> int:
        """Number of the frame."""
        packed = self.compress(data)
        self.out.write(packed)
        self.sizes.append((len(packed), len(data)))
        self.written += len(packed)
        return len(self.sizes) - 1

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE))
        self.out.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, name: str):
        import zstandard

        fs, path = _filesystem(name)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        entries = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.sizes = [struct.unpack_from("<II", entries, 8 * k) for k in range(n)]
        self.offsets = [0]
        for packed, _ in self.sizes:
            self.offsets.append(self.offsets[-1] + packed)
        self.expand = zstandard.ZstdDecompressor().decompress

    def frame(self, k: int) -> bytes:
        packed, size = self.sizes[k]
        return self.expand(self.file.read_at(packed, self.offsets[k]), max_output_size=size)

    def __len__(self) -> int:
        return len(self.sizes)


INDEX = "page_id long, bundle string, frame int, offset long, length long"


def write_archives(pages: DataFrame, folder: str, *, least: int = LEAST, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html); the index, written beside the bundles.

    Of the records with equal payloads of at least ``least`` bytes that with the smallest page_id is a response and
    the others are revisits of it; all others are responses. Index columns: page_id, bundle (path), and frame, offset
    and length of the record in the decompressed frame. A task keeps one frame in memory. A task that is run again
    writes new bundles; only those in the index count.

    Null html is an empty payload, a null url leaves out the target. A null page_id is a response always, and never
    referred to. Repeated rows of one page_id are responses each if theirs is the smallest id. No rows: an empty index.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    # only ids and digests meet by digest, however many records share one; pages then meet their own row of that
    digests = stored(rows.where((F.col("size") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest"), "payload-digests")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = stored(digests.join(first, "digest").where("page_id > refers_to").distinct(), "revisits")
    typed = rows.join(revisits, ["page_id", "digest"], "left").select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "size", "digest", "refers_to")
    bundles = folder.rstrip("/") + "/bundles"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def indexed() -> Iterator[tuple]:
            out, held, places = None, [], []

            def flush() -> Iterator[tuple]:
                nonlocal out, held, places
                if not held:
                    return
                out = out or BundleWriter(bundles)
                k, at = out.frame(b"".join(held)), 0
                for page_id, n in places:
                    yield page_id, out.name, k, at, n
                    at += n
                held, places = [], []

            size = 0
            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "size", "digest", "refers_to")), strict=True):
                    page_id, url, html, payload_bytes, digest, refers_to = r
                    kind = "response" if refers_to is None else "revisit"
                    held.append(record_bytes(Record(page_id, kind, url, digest, (html or "").encode(), payload_bytes, refers_to)))
                    places.append((page_id, len(held[-1])))
                    size += len(held[-1])
                    if size >= frame:
                        yield from flush()
                        size = 0
                        if out and out.written >= bundle:
                            out.close()
                            out = None
            yield from flush()
            if out:
                out.close()

        yield from rows_to_batches(["page_id", "bundle", "frame", "offset", "length"], [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()], indexed())

    typed.mapInArrow(write, INDEX).write.parquet(folder.rstrip("/") + "/index")
    return spark.read.schema(INDEX).parquet(folder.rstrip("/") + "/index")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that the rows of an index name, each frame that holds one read once.

    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, where asked for, payload
    (empty for a revisit). Payloads of responses are checked against their digests. A task reads about ``READ`` bytes
    of records, slices of ``SLICE`` frames, in order; memory holds one frame.
    """
    spark = index.sparkSession
    stored_bytes = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(spark.sparkContext.defaultParallelism, -(-stored_bytes // READ))
    piece = F.floor(F.col("frame") / SLICE)
    wanted = index.select("bundle", "frame", "offset").repartition(n, "bundle", piece).sortWithinPartitions("bundle", "frame", "offset")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            name, reader, number, frame = None, None, None, {}
            for batch in batches:
                for bundle, k, offset in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset")), strict=True):
                    if bundle != name:
                        name, reader, number = bundle, BundleReader(bundle), None
                    if k != number:
                        number, frame = k, {at: r for at, _, r in parse_records(reader.frame(k))}
                    r = frame[offset]
                    yield (r.page_id, r.url or None, r.payload_bytes, r.digest, r.kind, r.refers_to, *([r.payload] * with_payload))

        yield from rows_to_batches(names, types, rows(), 512)

    return wanted.mapInArrow(read, RECORD + ", payload binary" * with_payload)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, as read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    index = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first AND payload_bytes >= 100 THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
