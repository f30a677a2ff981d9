"""Web archives: pages as legacy ARC files, their conversion to WARC, and reading either back.

The converter reads the version block of an ARC file, takes each record's header line by the field
names of that version and its body by the declared length, and writes the equivalent WARC records
with identifiers, timestamps, types and digests of their own.  Records whose payload a page with a
smaller id has become revisits, which name that record.  Files are written and read by Spark, so any of its stores will do; a file
holds about FILE_BYTES of payload, and is parsed whole by one task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .shared import Scratch, maybe_in, membership

FILE_BYTES = 8 << 20
DATE = "20240101000000"  # pages carry no time of their own
IP = "0.0.0.0"
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def version_block(version: int, name: str) -> str:
    """The first record of an ARC file, without its last newline."""
    body = f"{version} 0 helixframe\n{' '.join(FIELDS[version])}\n"
    head = {"URL": f"filedesc://{name}", "IP-address": IP, "Archive-date": DATE, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return f"{' '.join(head[f] for f in FIELDS[version])}\n{body}"


def arc_record(version: int, url: str, body: str, offset: int, name: str) -> str:
    size = len(body.encode())
    head = {"URL": quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%-._~"), "IP-address": IP, "Archive-date": DATE, "Content-type": "text/html", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(size)}
    return f"{' '.join(head[f] for f in FIELDS[version])}\n{body}"


def http_message(page_id: int | None, payload: str) -> str:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}\r\n{payload}"


def parse_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record after the version block, which names the fields."""
    line, at = content.find(b"\n"), 0
    if line < 0 or not content.startswith(b"filedesc:"):
        raise ValueError("an ARC file begins with a filedesc record")
    size = int(content[:line].rsplit(b" ", 1)[1])
    block = content[line + 1 : line + 1 + size].decode().split("\n")
    version, names = int(block[0].split(" ")[0]), block[1].split(" ")
    if tuple(names) != FIELDS.get(version):
        raise ValueError(f"unknown ARC version {version} with fields {names}")
    at = line + 1 + size
    while at < len(content):
        if content[at] == 10:  # records are set apart by newlines
            at += 1
            continue
        line = content.index(b"\n", at)
        values = content[at:line].decode().split(" ")
        if len(values) != len(names):
            raise ValueError(f"a version {version} header has {len(names)} fields: {values}")
        head = dict(zip(names, values, strict=True))
        size = int(head["Archive-length"])
        if line + 1 + size > len(content):
            raise ValueError("a record is shorter than its declared length")
        yield head, content[line + 1 : line + 1 + size]
        at = line + 1 + size


def parse_http(message: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = message.partition(b"\r\n\r\n")
    fields = (x.partition(":") for x in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in fields}, payload


def record_id(url: str, date: str, where: str) -> str:
    """The identifier of a record, which stands at one place of one file: no two share it, and converting again gives it again."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {where}')}"


def warc_date(arc: str) -> str:
    a = arc.ljust(14, "0")
    return f"{a[:4]}-{a[4:6]}-{a[6:8]}T{a[8:10]}:{a[10:12]}:{a[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: str) -> str:
    """A record but for its last line end, which the writer of lines adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.0\r\n{head}Content-Length: {len(block.encode())}\r\n\r\n{block}\r\n"


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by its declared length."""
    at = 0
    while at < len(content):
        if not content.startswith(b"WARC/1.", at):
            raise ValueError("a record begins with its WARC version")
        end = content.index(b"\r\n\r\n", at)
        fields = (x.partition(":") for x in content[at:end].decode().split("\r\n")[1:])
        head = {k.strip(): v.strip() for k, _, v in fields}
        size = int(head["Content-Length"])
        yield head, content[end + 4 : end + 4 + size]
        at = end + 4 + size
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record is not as long as it declares")
        at += 4


def _packed(records: Iterator[str], head: Callable[[int], str], sep: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows that are files each: records until file_bytes is reached, after a head of its own."""
    n, pack, size = 0, [], 0
    for record in records:
        if not pack:
            pack.append(head(n))
        pack.append(record)
        size += len(record)
        if size >= file_bytes:
            yield T.rows(value=pa.array([sep.join(pack)], pa.string()))
            n, pack, size = n + 1, [], 0
    if pack:
        yield T.rows(value=pa.array([sep.join(pack)], pa.string()))


def _write(files: DataFrame, path: str, sep: str) -> None:
    files.write.option("lineSep", sep).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def write_arc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes pages (page_id, url, html) as gzipped ARC files, of either version by task.

    A task writes the rows that it reads, a file for each file_bytes of records; nothing is shuffled.
    """

    def f(batches):
        part = TaskContext.get().partitionId()
        version = 1 + part % 2

        def records():
            offset = 0
            for batch in batches:
                for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    yield arc_record(version, url, http_message(page_id, html or ""), offset, f"part-{part}")
                    offset += 1

        yield from _packed(records(), lambda n: version_block(version, f"part-{part}-{n}.arc"), "\n", file_bytes)

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    _write(pages.mapInArrow(f, "value string"), path, "\n")


_RECORD = "page_id long, url string, ip string, date string, mime string, version int, payload string, payload_bytes long, digest string, id string"


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files, with the digests of their payloads and the identifiers that WARC records will have."""

    def f(batches):
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                out, n = [], 0
                content = gzip.decompress(content.as_py())
                if not content:  # what Spark writes for an empty table
                    continue
                version = 2 if b" Checksum " in content[: content.find(b"\n", content.find(b"\nURL ") + 1)] else 1
                for head, body in parse_arc(content):
                    http, payload = parse_http(body)
                    page = http.get("x-page-id")
                    out.append((int(page) if page else None, head["URL"], head["IP-address"], head["Archive-date"], head["Content-type"], version, payload.decode(), len(payload), payload_digest(payload), record_id(head["URL"], head["Archive-date"], f"{name} {n}")))
                    n += 1
                    if len(out) == 500:
                        yield _records(out)
                        out = []
                if out:
                    yield _records(out)

    return _files(spark, path).mapInArrow(f, _RECORD)


def _records(out: list[tuple]) -> pa.RecordBatch:
    s, n = pa.string(), pa.int64()
    kinds = (n, s, s, s, s, pa.int32(), s, n, s, s)
    names = [x.split(" ")[0] for x in _RECORD.split(", ")]
    return T.rows(**{c: pa.array(x, k) for c, x, k in zip(names, zip(*out, strict=True), kinds, strict=True)})


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select(F.substring_index("path", "/", -1).alias("name"), "content")


def _as_warc(r: dict) -> str:
    first = r.get("first")
    fields = [
        ("WARC-Type", "revisit" if first else "response"),
        ("WARC-Target-URI", r["url"]),
        ("WARC-Date", warc_date(r["date"])),
        ("WARC-Record-ID", f"<{r['id']}>"),
        ("WARC-IP-Address", r["ip"]),
        ("WARC-Payload-Digest", f"sha1:{r['digest']}"),
        ("X-Payload-Length", str(r["payload_bytes"])),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if first:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{first['id']}>"),
            ("WARC-Refers-To-Target-URI", first["url"]),
            ("WARC-Refers-To-Date", warc_date(first["date"])),
            ("X-Refers-To-Page", str(first["page_id"])),
        ]
    return warc_record(fields, http_message(r["page_id"], "" if first else r["payload"]))


def _warc_files(kind: str, file_bytes: int):
    def f(batches):
        part = TaskContext.get().partitionId()

        def info(n: int) -> str:
            name = record_id("warcinfo:", DATE, f"{kind}-{part}-{n}")
            return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", warc_date(DATE)), ("Content-Type", "application/warc-fields")], "software: helixframe\r\nformat: WARC File Format 1.0\r\n")

        yield from _packed((_as_warc(r) for batch in batches for r in batch.to_pylist()), info, "\r\n", file_bytes)

    return f


def _of_revisits(bitmap, wanted: bool):
    """The records whose key is in the bitmap, or those for which it isn't or that have no page_id."""

    def f(batches):
        for batch in batches:
            found = maybe_in(bitmap.value, batch.column("key").to_numpy()) & batch.column("page_id").is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(found if wanted else ~found))

    return f


def convert_to_warc(records: DataFrame, path: str, scratch: Scratch, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes read_arc()'s records as gzipped WARC files.

    Of records with equal payloads of at least min_bytes that with the least page_id is a response,
    and those of other pages refer to it; among several of that page they refer to the one with the
    least identifier.  Records without page_id are responses.  A page_id may stand for several payloads.
    A bitmap tells most responses from revisits where they are read; only the rest is shuffled, and
    joined exactly.
    """
    records = records.withColumn("key", F.xxhash64("page_id", "digest"))
    ids = scratch.table(records.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_bytes)).select("page_id", "digest", "id", "url", "date"), "ids")
    first = ids.groupBy("digest").agg(F.min(F.struct("page_id", "id", "url", "date")).alias("first"), F.max("page_id").alias("last")).where("last <> first.page_id").drop("last")
    known = ids.select("page_id", "digest").join(first, "digest").where("first.page_id <> page_id").distinct()
    known = scratch.table(known, "revisits")
    bitmap = records.sparkSession.sparkContext.broadcast(membership(known.select(F.xxhash64("page_id", "digest").alias("key")), "key"))
    direct = records.mapInArrow(_of_revisits(bitmap, False), records.schema)
    others = records.mapInArrow(_of_revisits(bitmap, True), records.schema).join(known, ["page_id", "digest"], "left")
    files = direct.mapInArrow(_warc_files("direct", file_bytes), "value string").unionByName(others.mapInArrow(_warc_files("joined", file_bytes), "value string"))
    _write(files, path, "\r\n")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id, refers_to_record, payload) of WARC files.

    A response's payload is measured and digested again, and has to agree with its header.
    """

    def f(batches):
        for batch in batches:
            for content in batch.column("content"):
                out = []
                for head, block in parse_warc(gzip.decompress(content.as_py())):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    http, payload = parse_http(block)
                    page, size, digest = http.get("x-page-id"), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = head["WARC-Type"] == "response"
                    if response and (size != len(payload) or digest != payload_digest(payload)):
                        raise ValueError(f"the payload of {head['WARC-Record-ID']} differs from its header")
                    refers = head.get("X-Refers-To-Page")
                    out.append((int(page) if page else None, size, digest, head["WARC-Type"], int(refers) if refers else None, head["WARC-Target-URI"], head["WARC-Record-ID"], head.get("WARC-Refers-To"), payload.decode() if response else None))
                    if len(out) == 500:
                        yield _warc_rows(out)
                        out = []
                if out:
                    yield _warc_rows(out)

    return _files(spark, path).mapInArrow(f, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, refers_to_record string, payload string")


def _warc_rows(out: list[tuple]) -> pa.RecordBatch:
    s, n = pa.string(), pa.int64()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "refers_to_record", "payload")
    return T.rows(**{c: pa.array(x, k) for c, x, k in zip(names, zip(*out, strict=True), (n, n, s, s, n, s, s, s, s), strict=True)})


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html, ...) as ARC, converts that to WARC, and reads the WARC back.

    A null html is an empty payload, a null url ``about:blank``.  Rows without page_id become
    responses.  Repeated rows are responses or revisits alike, each with an identifier of its own; one
    page_id with several payloads is a record for each.  An empty table gives no files and an empty
    result.  Other columns are ignored.  min_bytes: see convert_to_warc().
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "archives")
    arc, warc = scratch.new_path("arc"), scratch.new_path("warc")
    write_arc(pages, arc)
    convert_to_warc(read_arc(spark, arc), warc, scratch, min_bytes)
    return read_warc(spark, warc)
