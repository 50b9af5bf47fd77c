"""WARC archives as seekable zstandard bundles.

A bundle is a file of independent zstandard frames, each of some whole records, then a skippable frame
with the index (record id to frame, offset in the frame, length), then the seek table of the seekable
format (sizes of all frames) with its footer. A reader finds a record from the end of the file: footer,
seek table, index, one frame.

Spark writes and reads the files, so they may lie wherever Spark's file systems reach. The text writer
puts one row of bytes in each file and the four last bytes of the footer as its line end.

Records with equal payloads of at least ``least`` bytes are written once: the one with the smallest page
id is a response, the others are revisits that name it. The smallest ids are found by a partial
aggregation over digests; pages meet them in one join that the planner may split at common digests.

Cases: null html is an empty payload; null urls are empty. Null page ids come last: such a page is a
revisit if a page with an id has its payload, else a response. Repeated rows with the smallest id are all
responses. An empty table gives archives without records. A record larger than a bundle is a bundle of
its own. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bastionlog.session import shared_folder

LEAST = 0
FRAME_BYTES = 128 << 10
BUNDLE_BYTES = 2 << 20
LEVEL = 6
# Fixed values of the zstandard seekable format.
SKIPPABLE, SEEK_TABLE, INDEX_FRAME, FOOTER = 0x184D2A50, 0x184D2A5E, 0x184D2A5A, b"\xb1\xea\x92\x8f"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


def one_line(value: str | None) -> str:
    """A header value without control characters."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with its HTTP head alone."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_name(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Refers-To: <{record_name(refers_to)}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class Bundle:
    """Records gathered into frames, frames into a file."""

    def __init__(self, frame_bytes: int) -> None:
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open: list[bytes] = []
        self.filled = self.size = 0

    def add(self, name: str, content: bytes) -> None:
        if self.open and self.filled + len(content) > self.frame_bytes:
            self.flush()
        self.index.append((name, len(self.frames), self.filled, len(content)))
        self.open.append(content)
        self.filled += len(content)

    def flush(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.filled))
            self.size += len(frame)
            self.open, self.filled = [], 0

    def content(self) -> bytes:
        self.flush()
        index = skippable(INDEX_FRAME, self.packer.compress(json.dumps(self.index).encode()))
        entries = [*self.sizes, (len(index), 0)]
        table = b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<IB", len(entries), 0) + FOOTER
        return b"".join(self.frames) + index + skippable(SEEK_TABLE, table)


class Reader:
    """A bundle read from its end."""

    def __init__(self, content: bytes) -> None:
        if content[-4:] != FOOTER:
            raise ValueError("not a seekable bundle")
        count, flags = struct.unpack("<IB", content[-9:-4])
        wide = 12 if flags & 0x80 else 8
        begin = len(content) - 9 - wide * count
        self.content, self.frames, at = content, [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", content, begin + wide * i)
            self.frames.append((at, packed, plain))
            at += packed
        self.unpacker = zstandard.ZstdDecompressor()
        start, packed, _ = self.frames.pop()
        self.index = json.loads(self.unpacker.decompress(content[start + 8 : start + packed]))
        self.kept = (-1, b"")

    def frame(self, number: int) -> bytes:
        if self.kept[0] != number:
            at, packed, plain = self.frames[number]
            self.kept = number, self.unpacker.decompress(self.content[at : at + packed], max_output_size=plain)
        return self.kept[1]

    def records(self, names: set[str] | None = None) -> Iterator[bytes]:
        """Records by the index; only the frames that hold one of ``names`` are unpacked."""
        for name, frame, offset, length in self.index:
            if names is None or name in names:
                yield self.frame(frame)[offset : offset + length]


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def page_of(name: str) -> int | None:
    number = name.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def described(content: bytes) -> tuple:
    """What a record says of its page, with length and digest of the payload that is there."""
    headers, block = parse(content)
    head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = headers["WARC-Type"]
    length = int(http["Content-Length"]) if kind == "revisit" else len(payload)
    sha = headers["WARC-Payload-Digest"].removeprefix("sha1:") if kind == "revisit" else digest(payload)
    refers = page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
    return page_of(headers["WARC-Record-ID"]), length, sha, kind, refers, headers["WARC-Target-URI"]


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` (page_id, url, html) with refers_to, null for responses."""
    html = F.coalesce("html", F.lit(""))
    one = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("sha", F.sha1("html"))
    shared = (
        one.filter(F.octet_length("html") >= least)
        .groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("first").isNotNull() & (F.col("n") > 1))
        .select("sha", "first")
    )
    later = F.coalesce(F.col("page_id") > F.col("first"), F.col("first").isNotNull())
    return one.join(shared, "sha", "left").select("page_id", "url", "html", F.when(later, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to bundles in ``folder``."""

    def bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = Bundle(frame_bytes)
        for batch in batches:
            # Ids come as text: beside a null, whole numbers would become floats.
            number = lambda x: None if x is None else int(x)
            for page_id, url, html, refers in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                page_id = number(page_id)
                made.add(record_name(page_id), record(page_id, url, html.encode("utf-8", "surrogatepass"), number(refers)))
                if made.size >= bundle_bytes:
                    yield pd.DataFrame({"content": [made.content().removesuffix(FOOTER)]})
                    made = Bundle(frame_bytes)
        if made.index:
            yield pd.DataFrame({"content": [made.content().removesuffix(FOOTER)]})

    ids = {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}
    packed = with_revisits(pages, least).withColumns(ids).mapInPandas(bundles, "content binary")
    (
        packed.select(F.col("content").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", FOOTER.decode("latin-1"))
        .option("maxRecordsPerFile", 1)
        .text(folder)
    )


def bundle_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).filter(F.col("length") > 0).select("path", "content")


def read_archives(spark: SparkSession, folder: str, names: set[str] | None = None) -> DataFrame:
    """What the records of the bundles in ``folder`` say; only those of ``names``, if given."""

    def described_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                rows = pd.DataFrame([described(r) for r in Reader(content).records(names)], columns=columns, dtype=object)
                yield rows.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    return bundle_files(spark, folder).mapInPandas(described_in, RECORD)


def index_of(spark: SparkSession, folder: str) -> DataFrame:
    """path, record_id, frame, offset, length of every record."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(path, *entry) for entry in Reader(content).index]
                yield pd.DataFrame(rows, columns=["path", "record_id", "frame", "offset", "length"])

    schema = "path string, record_id string, frame int, offset long, length long"
    return bundle_files(spark, folder).mapInPandas(listed, schema)


def archived(spark: SparkSession, pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` to a new folder of archives in the shared folder, and read them back."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, least)
    return read_archives(spark, folder)
