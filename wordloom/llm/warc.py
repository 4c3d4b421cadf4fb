"""WARC archives: written with an index first, read back by coalesced byte ranges.

Every record is a gzip member of its own. Writing gives one index row per
record (file, offset, length, URL, digest); the rows selected of an index are
sorted by place, neighbouring ranges become one read, and the records are
parsed from it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Equal payloads of at least so many bytes are stored once.
LEAST_BYTES = 100
#: A file is closed beyond this size; a read takes in gaps up to GAP and ends beyond READ.
FILE, GAP, READ = 1 << 30, 1 << 16, 1 << 22
SALTS = 8
SPACE = uuid.UUID("6f1d1c1e-5f0b-4a55-9c57-0d6b1f9a2c11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def resolved(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as page_id, url, payload, digest and refers_to.

    Of equal payloads of LEAST_BYTES and more, all refer to the smallest page_id
    but that row itself; a null html is an empty payload. Payloads meet the
    repeated digests salted, so that one held by many pages is spread; those too
    short to have a first are spread over all tasks.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    short, salt = F.octet_length("payload") < LEAST_BYTES, F.xxhash64("page_id", "url")
    rows = rows.withColumn("salt", F.when(short, -1 - F.pmod(salt, F.lit(1 << 20))).otherwise(F.pmod(salt, F.lit(SALTS))).cast("int"))
    repeated = rows.where(~short).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    salted = repeated.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.join(salted, ["digest", "salt"], "left").select("page_id", "url", "payload", "digest", F.expr("CASE WHEN NOT (page_id <=> first) THEN first END").alias("refers_to"))


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page} {digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One record. A null url or page has no header; line ends of a url, which no header can hold, are percent-encoded."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    head += [] if url is None else [f"WARC-Target-URI: {url.replace('\r', '%0D').replace('\n', '%0A')}"]
    if first is not None:
        head += [f"WARC-Refers-To: {record_id(first, digest)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {first}"]
    head += [] if page is None else [f"X-Page: {page}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """page_id, url, type, payload bytes, digest, refers_to and payload (None in a revisit) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = int(fields["X-Page"]) if "X-Page" in fields else None
    if fields["WARC-Type"] == "response":
        return page, fields.get("WARC-Target-URI"), "response", len(payload), hashlib.sha256(payload).hexdigest(), None, payload
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return page, fields.get("WARC-Target-URI"), "revisit", size, fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Refers-To-Page"]), None


def write(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write resolved() rows as archives in the folder; the index. A task that runs again writes files of new names, and only the last run's are indexed."""

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            found: list[tuple] = []
            for page, url, payload, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None or at > FILE:
                    if out is not None:
                        out.close()
                    name, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(name, compression=None)
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = squeeze.compress(record(page, url, payload, digest, first, date)) + squeeze.flush()
                out.write(data)
                found.append((page, url, name.rpartition("/")[2], at, len(data), digest, "response" if first is None else "revisit"))
                at += len(data)
            cols = list(zip(*found)) or [()] * 7
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "url", "file", "offset", "length", "digest", "record_type"])
        if out is not None:
            out.close()

    return rows.mapInArrow(run, INDEX)


def ranges(places: list[tuple[str, int, int]]) -> list[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) as reads: file, start, end and the records' places in it."""
    out: list[tuple] = []
    for file, offset, length in places:
        if out and out[-1][0] == file and 0 <= offset - out[-1][2] <= GAP and offset + length - out[-1][1] <= READ:
            out[-1] = (file, out[-1][1], offset + length, out[-1][3])
        else:
            out.append((file, offset, offset + length, []))
        out[-1][3].append((offset - out[-1][1], length))
    return out


def read(index: DataFrame, folder: str, payloads: bool = False, task_bytes: int = 1 << 24) -> DataFrame:
    """The records that the index rows select, parsed from the archives; with payloads also `payload` (null in revisits).

    Each task reads about task_bytes, by neighbouring ranges of twice that: the
    number of tasks comes from the lengths in the index, not from its own size.
    A url's line ends come back percent-encoded, a null one as null.
    """
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // task_bytes))

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            for file, start, end, inside in ranges(places):
                if file != name:
                    name, source = file, system.open_input_file(f"{root}/{file}")
                data = source.read_at(end - start, start)
                found = [parse(zlib.decompress(data[a : a + n], 31)) for a, n in inside]
                cols = list(zip(*found))
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
                n = 7 if payloads else 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], types[:n])], names=names[:n])

    spread = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / (2 * task_bytes)))
    return spread.sortWithinPartitions("file", "offset").mapInArrow(run, RECORD + ", payload binary" * payloads)


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write pages(page_id, url, html; other columns are left out) to the shared folder: the index, and where the archives lie.

    An empty table gives an empty index; repeated rows give a record each, and
    rows that equal the first of their payload are responses like it.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.path}/archives"
    return scratch.keep(write(resolved(pages), folder), "index"), folder
