"""WARC archives, compressed record by record with a Zstandard dictionary.

Each task builds a dictionary from the first records it archives, writes it
in a leading skippable frame (magic 0x184D2A5D) and compresses every record
as a frame of its own, so a reader can begin at any record. Payloads of at
least ``MIN_REVISIT`` bytes that occur more than once are stored once, with
the record of the largest page_id; the others are revisit records.

Archives go to the shared folder under names of one attempt only and are
moved into place when complete; a written manifest names the archives of the
attempts that counted. Reading streams the archives of the manifest, one
frame at a time.

Defined results: null html is an empty payload, always a response; a null
page_id counts as smaller than any other, and rows that repeat the largest
page_id are all responses. A null url leaves its header out; line ends in a
url are percent-encoded. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelab.llm.shared import shared_dir, written

MIN_REVISIT = 1000
#: Bytes of records a task looks at for a dictionary, the dictionary's size,
#: and the payload bytes of one archive.
SAMPLE, DICTIONARY, ARCHIVE = 4 << 20, 64 << 10, 64 << 20
SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"


def record(page_id, url, html: bytes, refers_to, revisit: bool, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header and no payload."""
    digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    block = http if revisit else http + html
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, record_type, payload_bytes, payload_digest (hex), refers_to and
    the payload of a record; a response's digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    return {"page_id": number(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"), "record_type": h["WARC-Type"], "payload_bytes": size,
            "payload_digest": digest, "refers_to": number(h.get("WARC-Refers-To")), "payload": payload if h["WARC-Type"] == "response" else None}


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or no bytes where the samples are too few for one."""
    total = sum(map(len, samples))
    if len(samples) < 8 or total < 16 << 10:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, total // 8), samples, d=8, steps=1, level=3).as_bytes()
    except zstandard.ZstdError:     # samples without anything in common
        return b""


def _archive(sink, first: list[bytes], rest, limit: int) -> tuple[int, int]:
    """Write one archive: the dictionary of ``first``, then its records and
    those of ``rest`` up to ``limit`` bytes."""
    words = dictionary(first)
    sink.write(struct.pack("<II", SKIPPABLE, len(words)) + words)
    z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    n = size = 0
    for raw in first:
        sink.write(z.compress(raw))
        n, size = n + 1, size + len(raw)
    while size < limit and (raw := next(rest, None)) is not None:
        sink.write(z.compress(raw))
        n, size = n + 1, size + len(raw)
    return n, size


def read_archive(stream):
    """The records of an archive, from an object with ``read``."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    words = stream.read(size)
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    left = b""
    while True:
        d = z.decompressobj()
        out = []
        while not d.eof:
            part = left or stream.read(1 << 18)
            if not part:
                if out:
                    raise ValueError("an archive ends within a record")
                return
            left = b""
            out.append(d.decompress(part))
        left = d.unused_data
        yield b"".join(out)


def _write(folder: str, limit: int):
    def run(batches):
        def records():
            for b in batches:
                for page_id, url, html, refers_to, revisit in zip(*(b.column(i).to_pylist() for i in range(5))):
                    yield record(page_id, url, (html or "").encode(), refers_to, revisit)
        rest = records()
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        out = []
        while True:
            first, size = [], 0
            while size < min(SAMPLE, limit) and (raw := next(rest, None)) is not None:
                first.append(raw)
                size += len(raw)
            if not first:
                break
            name = f"{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{path}/_{name}", compression=None) as sink:
                n, size = _archive(sink, first, rest, limit)
            fs.move(f"{path}/_{name}", f"{path}/{name}")
            out.append((name, n, size))
        cols = list(zip(*out)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])
    return run


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE) -> tuple[str, DataFrame]:
    """Archive ``pages(page_id, url, html)``: the folder and its manifest
    (archive, records, bytes)."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    elif folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    # narrow: which payloads occur more than once, and their largest page_id
    seen = p.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= MIN_REVISIT)
    copies = seen.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").select("digest", "holder")
    revisits = written(seen.join(written(copies), "digest").where("not (page_id <=> holder)")
                       .select(F.col("page_id").alias("of"), "digest", F.col("holder").alias("refers_to"), F.lit(True).alias("revisit")).distinct())
    marked = p.join(revisits, F.col("page_id").eqNullSafe(F.col("of")) & (F.sha1(F.col("html").cast("binary")) == F.col("digest")), "left") \
        .select("page_id", "url", "html", "refers_to", F.coalesce("revisit", F.lit(False)).alias("revisit"))
    return folder, written(marked.mapInArrow(_write(folder, archive_bytes), "archive string, records long, bytes long"))


def _read(folder: str):
    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for raw in read_archive(stream):
                        rows.append(parse(raw))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
    return run


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                      ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(folder: str, manifest: DataFrame) -> DataFrame:
    """The records of the archives of a manifest."""
    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n).mapInArrow(
        _read(folder), "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
