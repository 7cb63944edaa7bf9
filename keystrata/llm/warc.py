"""WARC archives in Zstandard, with a shared dictionary in a leading skippable frame.

An archive is a skippable frame that holds the dictionary (raw, or as a Zstandard frame of its own), then
one frame per record. Each task writes its own archives, under new names, and reports them; only reported
archives are read, so a task that runs twice does no harm. Readers hold one record and one block of the
file, check the version line, the header fields, the lengths and the digests, and raise on any damage.

A record is a response with its HTTP header and payload, or, where another record has an equal payload,
a revisit of it that carries the HTTP header alone. Equal payloads are found by SHA-1 with an aggregation
that combines before the exchange, so a payload that a third of all pages share costs a row per task. Only
payloads that occur twice are looked up again. The target of one that more than HOT_ROWS pages share is
broadcast (HOT_PAYLOADS of them at most), and its pages are dealt by their row instead of their payload.

Edge cases: a null payload is empty; rows without page_id are responses unless a page with an id has the
same payload; rows that repeat the smallest page_id are all responses; an empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import arrow_schema, as_batch, materialize, release, releasing, shared_dir
from keystrata.sources.hadoop import Files

# Fixed values of the formats.
SKIPPABLE_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES, READ_BYTES, READ_TASKS = 64 << 20, 1 << 20, 50_000
#: Pages that share a payload from which on it is broadcast, and how many such payloads at most.
HOT_ROWS, HOT_PAYLOADS = 10_000, 10_000
#: The dictionary is trained on so many payloads of limited size, drawn by a hash.
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 64 << 10, 200, 32 << 10


class DamagedArchive(ValueError):
    """The file breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for payloads like the samples; empty without enough of them."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if s]).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def http_block(payload: bytes | None, length: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + (payload or b"")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    block = http_block(None if refers_to is not None else payload, len(payload))
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url:
        fields.append(("WARC-Target-URI", "".join(url.splitlines())))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    def __init__(self, uri: str, dictionary: bytes) -> None:
        files, path = open_fs(uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out, self.records, self.size = uri, files.open_output_stream(path, compression=None), 0, 0
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary), write_checksum=True, write_content_size=True)
        self._write(struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._write(self.compressor.compress(data))
        self.records += 1

    def close(self) -> None:
        self.out.close()


def parse(data: bytes) -> dict:
    """Fields and block of one record, validated."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] != VERSION:
        raise DamagedArchive("not a WARC/1.1 record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b": ")
        if not colon:
            raise DamagedArchive("a header line without a name")
        fields[name.decode("utf-8", "replace").lower()] = value.decode("utf-8", "surrogatepass")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"):
        if need not in fields:
            raise DamagedArchive(f"a record without {need}")
    size = fields["content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise DamagedArchive("a block of another length than announced")
    block = rest[:-4]
    if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise DamagedArchive("a block with another digest than announced")
    http, sep, payload = block.partition(b"\r\n\r\n")
    lengths = [x.partition(b": ")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")]
    if not sep or len(lengths) != 1 or not lengths[0].isdigit():
        raise DamagedArchive("a block without an HTTP header")
    revisit = fields["warc-type"] == "revisit"
    if revisit and (payload or "warc-refers-to" not in fields):
        raise DamagedArchive("a revisit with a payload or without a target")
    if not revisit and (len(payload) != int(lengths[0]) or fields["warc-payload-digest"] != f"sha1:{sha1_base32(payload)}"):
        raise DamagedArchive("a payload of another length or digest than announced")
    return {"fields": fields, "payload": None if revisit else payload, "payload_bytes": int(lengths[0]), "revisit": revisit}


def read_archive(uri: str) -> Iterator[dict]:
    """The records of an archive, one frame at a time."""
    files, path = open_fs(uri)
    with files.open_input_stream(path, compression=None) as f:

        def exactly(n: int) -> bytes:
            out = b""
            while len(out) < n:
                more = f.read(n - len(out))
                if not more:
                    raise DamagedArchive("the file ends within a frame")
                out += more
            return out

        magic, size = struct.unpack("<II", exactly(8))
        if magic != SKIPPABLE_MAGIC:
            raise DamagedArchive("no leading dictionary frame")
        dictionary = exactly(size)
        if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
        decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)) if dictionary else zstandard.ZstdDecompressor()
        held = b""
        while held or (held := f.read(READ_BYTES)):
            frame, parts = decompressor.decompressobj(), []
            while True:
                parts.append(frame.decompress(held))
                if frame.eof:
                    held = frame.unused_data
                    break
                held = f.read(READ_BYTES)
                if not held:
                    raise DamagedArchive("the file ends within a frame")
            yield parse(b"".join(parts))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes (page_id, url, html) under folder; returns a stored table (path, records, bytes)."""
    with releasing() as keep:
        return _write(pages, folder, keep)


def _write(pages: DataFrame, folder: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark = pages.sparkSession
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b"")).alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    counted = keep(base.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Thinned before the sort, or every task would send its own SAMPLE_ROWS to the driver.
    share = min(1.0, 4 * SAMPLE_ROWS / max(1, total))
    drawn = base.where(F.length("payload").between(1, SAMPLE_BYTES) & (F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    few = drawn.select("page_id", "payload").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_ROWS)
    held = spark.sparkContext.broadcast(train_dictionary([bytes(r["payload"]) for r in few.collect()]))
    # total / many payloads at most are shared by many pages.
    many = max(HOT_ROWS, -(-total // HOT_PAYLOADS))
    hot = counted.where(F.col("n") > many).select("digest", F.col("first").alias("hot_first"), F.lit(True).alias("hot"))
    cold = counted.where(F.col("n").between(2, many)).select(F.col("digest").alias("key"), "first")
    row = F.concat(F.lit(b"row"), F.monotonically_increasing_id().cast("string").cast("binary"))
    marked = base.join(F.broadcast(hot), "digest", "left").withColumn("key", F.when(F.col("hot"), row).otherwise(F.col("digest")))
    first = F.coalesce("hot_first", "first")
    refers = F.when(F.col("page_id").isNull() | (first < F.col("page_id")), first)
    rows = marked.join(cold, "key", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    schema = arrow_schema("path string, records long, bytes long")

    def run(batches):
        now, done = None, []
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, digest, refers_to = (b.column(c)[i].as_py() for c in range(5))
                if now is None:
                    now = ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst", held.value)
                now.add(record(page_id, url, payload, base64.b32encode(digest).decode(), refers_to))
                if now.size >= ARCHIVE_BYTES:
                    now.close()
                    done.append(now)
                    now = None
        if now is not None:
            now.close()
            done.append(now)
        yield as_batch(schema, {"path": [w.uri for w in done], "records": [w.records for w in done], "bytes": [w.size for w in done]})

    return materialize(rows.mapInArrow(run, "path string, records long, bytes long"))


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives that a table names (column path): one file is one task's at a time."""
    schema = arrow_schema(RECORD)

    def number(urn: str | None) -> int | None:
        return int(urn[len("<urn:page:") : -1]) if urn and urn != "<urn:page:none>" else None

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                out, size = {f.name: [] for f in schema}, 0
                for r in read_archive(path):
                    f = r["fields"]
                    row = (number(f["warc-record-id"]), f.get("warc-target-uri"), r["payload_bytes"], f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"], number(f.get("warc-refers-to")), r["payload"] if payloads else None)
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                    size += 200 + (len(row[-1] or b""))
                    if size > 4 << 20:
                        yield as_batch(schema, out)
                        out, size = {f.name: [] for f in schema}, 0
                yield as_batch(schema, out)

    # An explicit number of partitions: the paths are few bytes, and would all be put into one task.
    tasks = min(max(1, archives.count()), READ_TASKS)
    out = archives.select("path").repartition(tasks).mapInArrow(run, RECORD)
    return out if payloads else out.drop("payload")


def round_trip(pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Writes the pages and reads them back. Without a folder the archives are scratch: the records become a
    stored table, and the archives go."""
    if folder:
        return read_archives(write_archives(pages, folder), payloads)
    spark, folder = pages.sparkSession, f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(pages, folder)
    out = materialize(read_archives(archives, payloads))
    release(archives)
    Files(spark, folder).delete(folder)
    return out
