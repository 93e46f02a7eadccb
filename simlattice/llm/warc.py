"""WARC archives with an index first.

Writing gives one row per record: archive, offset, length, URL and digest, staged as a table. Each record is a gzip member of
its own, so any of them can be read alone. Reading takes selected index rows, sorts them by place, and fetches neighbours by one
byte-range read. Archives go to the shared folder by pyarrow's file systems; a task that runs again writes a new archive, and
only the archives of tasks that ended well are in the index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, staged

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _open(uri: str):
    """pyarrow's file system for a URI, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object = None, revisit: bool = False, date: str = DATE) -> bytes:
    """One WARC record; a revisit has the HTTP headers of the full response, and no payload."""
    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: {sha}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """A record's headers, the HTTP content length, and the payload that it holds."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, int(re.search(rb"(?i)^content-length: (\d+)", http, re.M)[1]), payload


def _writer(root: str, level: int, most: int):
    names = ["archive", "offset", "length", "page_id", "url", "payload_bytes", "payload_digest", "record_type"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        fs, at = _open(root)
        fs.create_dir(at, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, refers, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    digest = hashlib.sha1(payload).hexdigest()
                    if out is None or offset >= most:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    data = gzip.compress(record(page_id, url, payload, digest, refers, revisit), level, mtime=0)
                    out.write(data)
                    rows.append((name, offset, len(data), page_id, url, len(payload), digest, "revisit" if revisit else "response"))
                    offset += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, least: int = 1000, level: int = 4, archive_bytes: int = 256 << 20) -> tuple[DataFrame, str]:
    """Writes one record for each row of pages(page_id, url, html) and returns the index and the archives' folder.

    Of rows with equal payloads of at least `least` bytes, those with the largest page_id are responses and the others revisit
    them; a null html is an empty payload. A null page_id is never referred to, and a null url is left out of the record. Rows
    equal in page_id and payload are decided alike. Other columns are not read. Empty in, empty index out.

    Digests decide in narrow tables; pages move at most once, by a key of their own, so a payload that many share is no hot key.
    """
    spark = pages.sparkSession
    root = new_path(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    kind = dict(pages.dtypes)["page_id"]
    own = pages.select(F.col("page_id"), "url", "html", F.md5(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), html)).alias("rk"))
    slim = own.filter(F.octet_length(html) >= least).select("page_id", "rk", F.sha1(html).alias("digest"))
    slim = staged(slim, "payloads")
    winners = staged(slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null"), "responses")
    revisits = slim.join(winners, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("rk", "refers_to").distinct()
    rows = own.join(staged(revisits, "revisits"), "rk", "left")
    rows = rows.select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"), F.col("refers_to").isNotNull().alias("revisit"))
    index = rows.mapInArrow(_writer(root, level, archive_bytes), "archive string, offset long, length long, page_id string, url string, payload_bytes long, payload_digest string, record_type string")
    return staged(index, "index").withColumn("page_id", F.col("page_id").cast(kind)), root


def _reader(root: str, gap: int, most: int, payload: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        fs, at = _open(root)
        archive, file = None, None

        def fetch(rows):
            nonlocal archive, file
            if rows[0][0] != archive:
                if file is not None:
                    file.close()
                archive, file = rows[0][0], fs.open_input_file(f"{at}/{rows[0][0]}")
            start, end = rows[0][1], rows[-1][1] + rows[-1][2]
            data = file.read_at(end - start, start)
            out = []
            for _, offset, length, digest in rows:
                fields, size, held = parse(gzip.decompress(data[offset - start : offset - start + length]))
                sha = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                kind = fields["WARC-Type"]
                if sha != digest or kind == "response" and (len(held) != size or hashlib.sha1(held).hexdigest() != sha):
                    raise ValueError(f"{archive} at {offset}: the digest is wrong")
                text = held.decode("utf-8", "surrogatepass") if payload and kind == "response" else None
                out.append((fields.get("WARC-Page-ID"), fields.get("WARC-Target-URI"), size, sha, kind, fields.get("WARC-Refers-To-Page-ID"), text))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        rows: list[tuple] = []
        try:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length", "payload_digest")), strict=True):
                    if rows and (row[0] != rows[0][0] or row[1] - (rows[-1][1] + rows[-1][2]) > gap or row[1] + row[2] - rows[0][1] > most):
                        yield fetch(rows)
                        rows = []
                    rows.append(row)
            if rows:
                yield fetch(rows)
        finally:
            if file is not None:
                file.close()

    return run


def read_records(index: DataFrame, root: str, payload: bool = True, gap: int = 64 << 10, most: int = 2 << 20, stretch: int = 32 << 20) -> DataFrame:
    """The records of the given index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html.

    Rows are dealt by stretches of an archive and sorted by offset; records that lie within gap bytes of each other are read
    at once, most bytes at a time. Digests are checked. html is null for revisits, and everywhere with payload=False."""
    kind = dict(index.dtypes)["page_id"]
    place = index.select("archive", "offset", "length", "payload_digest").withColumn("stretch", F.floor(F.col("offset") / stretch))
    place = place.repartition("archive", "stretch").sortWithinPartitions("archive", "offset")
    out = place.mapInArrow(_reader(root, gap, most, payload), "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string")
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
