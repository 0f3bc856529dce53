"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own. Two skippable frames follow: the
record index (identifier to frame and offset in the decompressed frame), and the seek table of
the public seekable format (sizes of all frames, the index as one of size zero), whose last
nine bytes are its footer. Any Zstandard reader still sees one plain WARC file, and one record
is read from the footer, the index and a single frame.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm._common import new_path, small_batches, stored, table

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
MIN_REVISIT = 1000
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
_INDEX, _TABLE, _FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:loomstat:warc")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record. The block is an HTTP response, of a revisit its header alone, which
    still tells the size of the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header, block and end of the record at ``at``."""
    body = data.index(b"\r\n\r\n", at) + 4
    lines = data[at : body - 4].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    end = body + int(head["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    return head, data[body:end], end + 4


class BundleWriter:
    """Writes records to a stream in frames; close() appends the index and the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress
        self.held, self.size, self.frames, self.index, self.written = [], 0, [], [], 0

    def add(self, identifier: str, data: bytes) -> None:
        self.index.append((identifier, len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            frame = self.compress(b"".join(self.held))
            self.out.write(frame)
            self.written += len(frame)
            self.frames.append((len(frame), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = self.compress(json.dumps(self.index).encode())
        self.out.write(struct.pack("<II", _INDEX, len(index)) + index)
        entries = [*self.frames, (8 + len(index), 0)]
        sizes = b"".join(struct.pack("<II", *e) for e in entries)
        self.out.write(struct.pack("<II", _TABLE, len(sizes) + 9) + sizes + struct.pack("<IBI", len(entries), 0, _FOOTER))
        self.out.close()


class Bundle:
    """Reads a bundle from a file with random access."""

    def __init__(self, file):
        self.file = file
        file.seek(file.size() - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != _FOOTER:
            raise ValueError("no seek table at the end")
        file.seek(file.size() - 9 - 8 * n)
        table_ = file.read(8 * n)
        at, self.frames = 0, []
        for k in range(n):
            packed, size = struct.unpack_from("<II", table_, 8 * k)
            self.frames.append((at, packed, size))
            at += packed
        start, packed, _ = self.frames.pop()
        file.seek(start + 8)
        self.index = json.loads(zstandard.decompress(file.read(packed - 8)))

    def frame(self, k: int) -> bytes:
        start, packed, size = self.frames[k]
        self.file.seek(start)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)

    def find(self, identifier: str) -> tuple[dict[str, str], bytes]:
        """Header and block of the record with this identifier, the last one if it repeats."""
        _, k, offset, _ = next(x for x in reversed(self.index) if x[0] == identifier)
        return parse(self.frame(k), offset)[:2]

    def records(self):
        """``frame, offset, header, block`` of all records, one frame in memory at a time."""
        now, data = -1, b""
        for identifier, k, offset, length in self.index:
            if k != now:
                now, data = k, self.frame(k)
            head, block, end = parse(data, offset)
            if head["WARC-Record-ID"] != identifier or end - offset != length:
                raise ValueError(f"the index does not fit record {identifier}")
            yield k, offset, head, block


def plan(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``.

    Of rows with equal payloads of at least MIN_REVISIT bytes, those with the largest page_id
    are responses, rows with a smaller or null id revisits of it. Smaller payloads, and groups
    without any id, are all responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    groups = rows.where(f"payload_bytes >= {MIN_REVISIT}").groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Small payloads, the empty one among them, are alike to no other and dealt by their rows.
    rows = rows.withColumn("key", F.expr(f"IF(payload_bytes >= {MIN_REVISIT}, payload_digest, concat('small ', pmod(xxhash64(page_id, url), 65536)))"))
    joined = rows.join(groups.select(F.col("payload_digest").alias("key"), "last"), "key", "left")
    again = F.expr("last IS NOT NULL AND (page_id IS NULL OR page_id < last)")
    return joined.select(
        "page_id", "url", F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("last")).alias("refers_to"),
    )


def write(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per row into bundles under ``folder`` (a URI all executors can reach)
    and return the manifest ``path, records``.

    A task that runs again writes bundles of new names; the manifest, stored when all tasks
    have ended, lists those of the attempt that counted. An empty table writes nothing.
    """
    small_batches(pages.sparkSession)

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        writer, path, n, done = None, "", 0, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if writer is None:
                    path, n = f"{root}/{uuid.uuid4().hex}.warc.zst", 0
                    writer = BundleWriter(store.open_output_stream(path, compression=None), frame_bytes)
                writer.add(record_id(row[0]), record(*row))
                n += 1
                if writer.written >= bundle_bytes:
                    writer.close()
                    done.append((path, n))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((path, n))
        if done:
            yield pa.record_batch([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return stored(plan(pages).mapInArrow(run, "path string, records long"), "warc-manifest")


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, bundle string, frame long, offset long"


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the listed bundles. Sizes and digests of responses are taken from
    the payload and must agree with the headers; a broken bundle raises."""

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, n in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                rows = []
                with store.open_input_file(path) as file:
                    for k, offset, head, block in Bundle(file).records():
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        digest, page, to = head["WARC-Payload-Digest"][5:], head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                        if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
                        rows.append((None if page is None else int(page), size, digest, head["WARC-Type"], None if to is None else int(to), head["WARC-Record-ID"], path, k, offset))
                if len(rows) != n:
                    raise ValueError(f"{path} holds {len(rows)} records, the manifest says {n}")
                names = [f.split()[0] for f in _READ.split(", ")]
                yield pa.record_batch([pa.array([r[c] for r in rows], pa.string() if "string" in f else pa.int64()) for c, f in enumerate(_READ.split(", "))], names=names)

    tasks = max(1, 2 * manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.repartition(tasks, "path").mapInArrow(run, _READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: archive all pages and read the archives back."""
    folder = new_path(spark, "warc")
    return read(write(table(spark, sf_dir, "pages"), folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p
), g AS (
  SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, d.payload_digest AS payload_digest,
       CASE WHEN last IS NOT NULL AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last IS NOT NULL AND page_id < last THEN last END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest
"""
