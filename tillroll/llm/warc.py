"""WARC archives, each record a Zstandard frame of its own, with the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import column, utf8_size
from tillroll.llm.files import create, new_folder, open_file, sample, train_dictionary
from tillroll.sources.scratch import hold

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILE_BYTES = 256 << 20
READ_ROWS = 1024
RECORD_ID = "<urn:page:%s>"
PAGE_OF = {RECORD_ID % "null": None}


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: bytes, headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [VERSION, b"WARC-Type: " + kind, *[k + b": " + v for k, v in headers]]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: bytes, payload: bytes, refers_to: int | None, date: bytes) -> bytes:
    """A response record, or a revisit record of ``refers_to`` that keeps the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [
        (b"WARC-Record-ID", (RECORD_ID % ("null" if page_id is None else page_id)).encode()),
        (b"WARC-Date", date),
        (b"WARC-Target-URI", url.replace(b"\r", b"%0D").replace(b"\n", b"%0A")),
        (b"Content-Type", b"application/http; msgtype=response"),
        (b"WARC-Payload-Digest", b"sha1:" + payload_digest(payload).encode()),
    ]
    if refers_to is None:
        return _record(b"response", headers, http + payload)
    headers += [(b"WARC-Profile", REVISIT_PROFILE), (b"WARC-Refers-To", (RECORD_ID % refers_to).encode())]
    return _record(b"revisit", headers, http)


def _writer(folder: str, dictionary: bytes, date: bytes):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True).compress
        files: list[str] = []
        counts: list[int] = []
        out = None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns[:4]):
                if out is not None and out.tell() >= FILE_BYTES:
                    out.close()
                    out = None
                if out is None:
                    address, out = create(folder, ".warc.zst")
                    files.append(address)
                    counts.append(0)
                    if dictionary:
                        out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                    out.write(compress(_record(b"warcinfo", _info_headers(address, date), b"format: WARC 1.1\r\n")))
                out.write(compress(page_record(page_id.as_py(), url.as_py(), html.as_py(), refers_to.as_py(), date)))
                counts[-1] += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": files, "records": pa.array(counts, pa.int64())})

    return write


def _info_headers(address: str, date: bytes) -> list[tuple[bytes, bytes]]:
    name = address.rsplit("/", 1)[-1].encode()
    return [
        (b"WARC-Record-ID", b"<urn:file:" + name + b">"),
        (b"WARC-Date", date),
        (b"WARC-Filename", name),
        (b"Content-Type", b"application/warc-fields"),
    ]


def write_archives(
    pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, date: str = "2000-01-01T00:00:00Z"
) -> DataFrame:
    """One record per row of ``pages``, in archives under ``folder``; returns the manifest (path, records).

    Of records with equal payloads of at least ``min_revisit_bytes``, the one with the largest page_id is
    the response and the others revisit it; smaller payloads are responses all. The dictionary is trained
    on a bounded sample of records (``files``) and embedded in every archive, so each stands alone.

    Null html is an empty payload, a null url an empty address. Rows that repeat the largest page_id are
    responses each. A null page_id is smaller than any other; where a payload has null ids only, all are
    responses. Other columns are ignored; an empty table writes no archive.

    Payloads are compared by SHA-256. Only groups of two or more reach the join, one row each, and a group
    with a third of all pages is met by partial maxima and by a join that splits its rows.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    html = F.coalesce(column("html"), F.lit(""))
    keyed = pages.select(
        column("page_id").cast("bigint").alias("page_id"),
        F.coalesce(column("url"), F.lit("")).cast("binary").alias("url"),
        html.cast("binary").alias("html"),
        F.sha2(html, 256).alias("same"),
    )
    leaders = hold(
        pages.filter(utf8_size(column("html")) >= min_revisit_bytes)
        .select(F.sha2(html, 256).alias("same"), column("page_id").cast("bigint").alias("page_id"))
        .groupBy("same")
        .agg(F.max("page_id").alias("leader"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("same", "leader"),
        "warc-leaders",
    )
    other = (F.col("leader") != F.col("page_id")) | (F.col("leader").isNotNull() & F.col("page_id").isNull())
    decided = keyed.join(leaders, "same", "left").select(
        "page_id", "url", "html", F.when(other, F.col("leader")).alias("refers_to")
    )
    payloads = sample(pages, column("page_id"), column("html"))
    records = [page_record(0, b"http://example.com/", p, None, date.encode()) for p in payloads]
    return hold(
        decided.mapInArrow(_writer(folder, train_dictionary(records), date.encode()), "path string, records bigint"),
        "warc-files",
    )


def _exactly(source, n: int) -> bytes:
    parts = []
    while n:
        got = source.read(n)
        if not got:
            raise ValueError("an archive that was cut off")
        parts.append(got)
        n -= len(got)
    return b"".join(parts)


class _Lines:
    """Records from the decompressed stream of an archive, one at a time."""

    def __init__(self, stream):
        self.stream, self.rest = stream, b""

    def head(self) -> dict[bytes, bytes] | None:
        while (end := self.rest.find(b"\r\n\r\n")) < 0:
            got = self.stream.read(1 << 16)
            if not got:
                if self.rest:
                    raise ValueError("an archive that was cut off")
                return None
            self.rest += got
        version, *lines = self.rest[:end].split(b"\r\n")
        if version != VERSION:
            raise ValueError("not a WARC record")
        self.rest = self.rest[end + 4 :]
        return dict(line.split(b": ", 1) for line in lines)

    def block(self, n: int) -> bytes:
        """The record's block; the two line ends behind it are passed over."""
        n += 4
        if len(self.rest) < n:
            self.rest += _exactly(self.stream, n - len(self.rest))
        block, self.rest = self.rest[: n - 4], self.rest[n:]
        return block


def records(address: str) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers and block of every record of an archive, by the dictionary in its first frame."""
    with open_file(address) as source:
        shared = None
        start = source.read(8)
        if len(start) == 8 and struct.unpack("<II", start)[0] == DICTIONARY_FRAME:
            shared = zstandard.ZstdCompressionDict(source.read(struct.unpack("<II", start)[1]))
        else:
            source.seek(0)
        stream = zstandard.ZstdDecompressor(dict_data=shared).stream_reader(source, read_across_frames=True)
        lines = _Lines(stream)
        while (head := lines.head()) is not None:
            yield head, lines.block(int(head[b"Content-Length"]))


def _page(record_id: bytes) -> int | None:
    text = record_id.decode()
    return PAGE_OF[text] if text in PAGE_OF else int(text[len("<urn:page:") : -1])


def _described(head: dict[bytes, bytes], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    kind = head[b"WARC-Type"].decode()
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("a payload that is not what its headers say")
    refers_to = _page(head[b"WARC-Refers-To"]) if kind == "revisit" else None
    return _page(head[b"WARC-Record-ID"]), size, digest, kind, refers_to


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        {
            "page_id": pa.int64(),
            "payload_bytes": pa.int64(),
            "payload_digest": pa.string(),
            "record_type": pa.string(),
            "refers_to": pa.int64(),
        }
    )

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows: list[tuple] = []
    for paths in batches:
        for path in paths.column(0).to_pylist():
            for head, block in records(path):
                if head[b"WARC-Type"] != b"warcinfo":
                    rows.append(_described(head, block))
                    if len(rows) == READ_ROWS:
                        yield batch(rows)
                        rows = []
    if rows:
        yield batch(rows)


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per page record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Digests and sizes of responses are checked against their payloads.
    """
    spread = manifest.select("path").repartition(
        int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path"
    )
    return spread.mapInArrow(
        _read,
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    )
