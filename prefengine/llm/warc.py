"""Web-archive packages: WARC records inside ZIP files, read by range without extraction.

A package is a ZIP file whose members are stored, not compressed: the archive
(``archive/data.warc.gz``, a gzip member per record), its index (``indexes/index.cdxj``) and a
``datapackage.json``.  The reader parses the end record and the central directory (ZIP64 included),
finds where the members' bytes lie in the file, takes the records' places from the index and reads
just those ranges.  Packages lie in the folder that the cluster shares; any folder that pyarrow's
file systems reach works.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefengine.llm.common import shared_table
from prefengine.session import shared_dir

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A package is closed when its payloads pass this; one range read takes in neighbours up to that.
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
#: Archive bytes that a task reads back, and the most tasks.
TASK_BYTES, MOST_TASKS = 128 << 20, 20_000


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


# ------------------------------------------------------------------ records
def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, record_id: str, url: str | None, digest: str, n_bytes: int, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC record: the HTTP response, or for a revisit its header only (whose Content-Length
    still tells the size of the full payload)."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Printable ASCII stays as it is in a header line, but for "%", which marks what was escaped.
SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ValueError("record shorter than its Content-Length")
    return headers, rest[:n]


# ------------------------------------------------------------------ ZIP directory
class Package:
    """The stored members of a ZIP file, by range reads of a random-access file."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        tail_at = max(0, size - (65_535 + 22 + 20))
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)  # the mark may also stand in the comment
        if end < 0:
            raise ValueError("no end-of-directory record: not a ZIP file")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if end >= 20 and tail[end - 20:end - 16] == b"PK\x06\x07":
            at, = struct.unpack_from("<Q", tail, end - 12)
            big = self.read(at, 56)
            if big[:4] != b"PK\x06\x06":
                raise ValueError("ZIP64 end record missing")
            count, length, start = struct.unpack_from("<QQQ", big, 32)
        self.members: dict[str, tuple[int, int, int]] = {}  # method, place of the local header, stored bytes
        directory, at = self.read(start, length), 0
        for _ in range(count):
            if directory[at:at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, = struct.unpack_from("<H", directory, at + 10)
            packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
            local, = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46:at + 46 + n_name].decode()
            extra, at = directory[at + 46 + n_name:at + 46 + n_name + n_extra], at + 46 + n_name + n_extra + n_comment
            k = 0
            while k + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, k)
                if kind == 1:  # ZIP64: only the fields that are all ones outside, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    local = next(wide) if local == 0xFFFFFFFF else local
                k += 4 + n
            self.members[name] = (method, local, packed)

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("file ends early")
        return data

    def place(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member lie: start in the file, length."""
        method, local, n = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed: it can't be read by range")
        head = self.read(local, 30)
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return local + 30 + n_name + n_extra, n


# ------------------------------------------------------------------ writing
def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, copy, url, digest, n_bytes, record_type, refers_to, refers_copy, payload): a row per
    page; revisits hold no payload.

    Payloads are compared by SHA-1.  Of equal ones the smallest page_id (null last) is the response.
    Copies are collapsed before they move: each map task sends a payload once, so a payload that a
    third of all pages share costs one copy a task."""
    id_, url = F.col(id_col).alias("page_id"), F.col(url_col).alias("url")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    hashed = pages.select(id_, url, payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    narrow = shared_table(hashed.drop("payload"), "warc-digests")
    narrow = narrow.withColumn("copy", F.row_number().over(Window.partitionBy("page_id", "sha").orderBy("url")))
    rank = F.struct(F.col("page_id").isNull().alias("void"), F.col("page_id").alias("page_id"))
    shared = F.col("n_bytes") >= min_revisit_bytes

    first = narrow.filter(shared).groupBy("sha").agg(F.min(rank).alias("first"))
    repeats = narrow.filter(shared).join(first, "sha").filter(~(F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("copy") == 1)))
    columns = ["page_id", "copy", "url", "sha", "n_bytes"]
    repeats = repeats.select(*columns, F.lit("revisit").alias("record_type"), F.col("first.page_id").alias("refers_to"), F.lit(None).cast("binary").alias("payload"))

    whole = F.struct(F.col("page_id").isNull().alias("void"), F.col("page_id").alias("page_id"), F.col("url").alias("url"))
    chosen = hashed.filter(shared).groupBy("sha", "n_bytes").agg(F.min(whole).alias("first"), F.first("payload").alias("payload"))
    response = [F.lit("response").alias("record_type"), F.lit(None).cast(repeats.schema["refers_to"].dataType).alias("refers_to"), "payload"]
    rows = repeats.unionByName(chosen.select(F.col("first.page_id").alias("page_id"), F.lit(1).alias("copy"), F.col("first.url").alias("url"), "sha", "n_bytes", *response))
    if min_revisit_bytes > 0:  # small payloads are all responses, each with its own bytes
        small = hashed.filter(~shared).withColumn("copy", F.row_number().over(Window.partitionBy("page_id", "sha").orderBy("url")))
        rows = rows.unionByName(small.select(*columns, *response))
    return rows


def name_of(page_id: int | None, copy: int) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{copy}"


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``plan_records`` rows as packages into ``folder``; returns (package, n_records, n_bytes).

    Each attempt of a task writes files of its own names and Spark commits the list of those of the
    attempts that count: what a lost executor or a second attempt left behind is never read."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "copy", "url", "sha", "n_bytes", "record_type", "refers_to", "payload"))))
        row = next(rows, None)
        while row is not None:
            name, index, at, held, n = f"{uuid.uuid4().hex}.wacz", [], 0, 0, 0
            with system.open_output_stream(f"{base}/{name}") as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED) as package:
                with package.open(ARCHIVE, "w", force_zip64=True) as member:
                    while row is not None and held < package_bytes:
                        page_id, copy, url, sha, n_bytes, kind, refers_to, payload = row
                        digest = base64.b32encode(sha).decode()
                        target = name_of(refers_to, 1) if kind == "revisit" else None
                        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                        data = packer.compress(record_bytes(kind, name_of(page_id, copy), url, digest, n_bytes, payload or b"", target, date)) + packer.flush()
                        member.write(data)
                        index.append(f"{name_of(page_id, copy)} {re.sub('[^0-9]', '', date)} " + json.dumps({"offset": at, "length": len(data), "digest": f"sha1:{digest}", "filename": ARCHIVE}))
                        at, held, n = at + len(data), held + n_bytes * (kind == "response") + 500, n + 1
                        row = next(rows, None)
                package.writestr(INDEX, "\n".join(index) + "\n")
                package.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE, "bytes": at}, {"path": INDEX}]}))
            yield pa.RecordBatch.from_pydict({"package": [name], "n_records": [n], "n_bytes": [at]})

    return shared_table(records.mapInArrow(write, "package string, n_records long, n_bytes long"), "warc-packages")


# ------------------------------------------------------------------ reading
def locate_records(packages: DataFrame, folder: str) -> DataFrame:
    """(package, start, length) of every record, from the packages' directories and indexes."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        for name in (x for b in batches for x in b.column("package").to_pylist()):
            with system.open_input_file(f"{base}/{name}") as file:
                package = Package(file, file.size())
                start, _ = package.place(ARCHIVE)
                lines = io.BytesIO(package.read(*package.place(INDEX)))
                places = [json.loads(line[line.index(b"{"):]) for line in lines if line.strip()]
            for k in range(0, len(places), 10_000):
                part = places[k:k + 10_000]
                yield pa.RecordBatch.from_pydict({"package": [name] * len(part), "start": [start + p["offset"] for p in part], "length": [p["length"] for p in part]})

    # about a package to a task: the number is given, since adaptive execution would judge by the bytes of the names
    packages = packages.select("package")
    return packages.repartition(max(1, min(packages.count(), MOST_TASKS)), "package").mapInArrow(locate, "package string, start long, length long")


def read_records(places: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Range-read the records: record_type, page_id, url, refers_to, payload_digest, payload_bytes
    and, if asked for, payload (null for revisits).  A payload that does not match its digest raises."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)

        def runs() -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
            run = None
            for name, start, length in (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("package", "start", "length")))):
                if run and run[0] == name and run[2] == start and start + length - run[1] <= RANGE_BYTES:
                    run[3].append((start, length))
                    run = (name, run[1], start + length, run[3])
                else:
                    if run:
                        yield run
                    run = (name, start, start + length, [(start, length)])
            if run:
                yield run

        for name, start, end, parts in runs():
            with system.open_input_file(f"{base}/{name}") as file:
                file.seek(start)
                data = file.read(end - start)
            out = {c: [] for c in ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")}
            for at, n in parts:
                headers, block = parse_record(zlib.decompress(data[at - start:at - start + n], 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?mi)^content-length:\s*(\d+)", http)[1])
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
                    raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
                url = headers.get("warc-target-uri")
                values = (page_of(headers["warc-record-id"]), None if url is None else unquote(url), kind, page_of(headers.get("warc-refers-to")), digest, size, payload if payloads and kind == "response" else None)
                for c, v in zip(out, values):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, SCHEMA) if payloads else pa.RecordBatch.from_pydict(out, SCHEMA).drop_columns(["payload"])

    columns = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payloads
    # tasks of about TASK_BYTES of archive, or as many as there are cores: given, as in locate_records
    places = shared_table(places, "warc-places")
    total = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    cores = places.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(max(total // TASK_BYTES, min(cores, total // RANGE_BYTES)), MOST_TASKS))
    stretch = F.floor(F.col("start") / RANGE_BYTES)
    return places.repartition(int(tasks), "package", stretch).sortWithinPartitions("package", "start").mapInArrow(read, columns)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def page_of(record_id: str | None) -> int | None:
    page = record_id.strip("<>").split(":")[2] if record_id else "null"
    return None if page == "null" else int(page)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                     min_revisit_bytes: int = 0, payloads: bool = False, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per page into packages in the shared folder and read all records back.

    Defined cases: null html is an empty payload; a null page_id comes after all others as response,
    a null url gives a record without target; repeated rows are records of their own, the first of
    them the response; equal ids with different payloads do not meet; a payload of any length is one
    record; an empty table writes no package and gives no rows; other columns are ignored."""
    folder = shared_dir(pages.sparkSession, "warc")
    packages = write_packages(plan_records(pages, id_col, url_col, html_col, min_revisit_bytes), folder, package_bytes)
    return read_records(locate_records(packages, folder), folder, payloads)
