"""WARC records in ZIP packages: a writer, and a reader that takes ranges of bytes.

Writing: a task packs its records into archives (each a ZIP of stored members: archive/data.warc.gz, a gzip member per record, and
indexes/index.cdxj, ZIP64 where sizes ask for it) in the shared folder, under a name of its own, then moves each to
its place, so a task that is run again leaves whole archives only, and only those that a finished task names are read.

Reading: the end record, its ZIP64 twin and the central directory are parsed from the tail of the file; local headers
give where stored members begin; the index member is read, and records are fetched by range from the archive member.
Nothing is extracted; only the record's own gzip member is inflated. Deflated ZIP members are refused.

Payloads of MINIMUM bytes or more that are equal: the least page_id keeps the payload (response), the others point to
it (revisit). Null html: empty payload. Null page_id: a response never pointed at; a revisit if an equal payload with an
id exists. Repeated rows of one id: all responses. Empty tables: no archives. Other columns are not written.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import has_columns, new_path

MINIMUM, MEMBER, INDEX = 100, "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 64 << 20  #: an archive is closed beyond that
TASK_BYTES = 4 << 20  #: of archives for each reading task, unless one archive has more


def record(kind: str, headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """A WARC/1.1 record with an HTTP response (revisit: its head only) as block."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]):
        raise ValueError("a WARC record is cut off")
    return headers, block.partition(b"\r\n\r\n")[2]


def zip_bytes(members: list[tuple[str, list[bytes]]]) -> Iterator[bytes]:
    """A ZIP of stored members, piece by piece."""
    import zlib

    central, at = [], 0
    for name, parts in members:
        crc, size = 0, 0
        for x in parts:
            crc, size = zlib.crc32(x, crc), size + len(x)
        big = size >= 0xFFFFFFFF or at >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        shown = 0xFFFFFFFF if big else size
        n = name.encode()
        local = struct.pack("<4s5H3L2H", b"PK\3\4", 45 if big else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(n), len(extra)) + n + extra
        wide = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
        central.append(struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(n), len(wide), 0, 0, 0, 0, 0xFFFFFFFF if big else at) + n + wide)
        yield local
        yield from parts
        at += len(local) + size
    directory = b"".join(central)
    yield directory
    if at >= 0xFFFFFFFF or len(central) >= 0xFFFF:
        yield struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, len(central), len(central), len(directory), at)
        yield struct.pack("<4sLQL", b"PK\6\7", 0, at + len(directory), 1)
    yield struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, min(len(central), 0xFFFF), min(len(central), 0xFFFF), min(len(directory), 0xFFFFFFFF), min(at, 0xFFFFFFFF), 0)


def zip_members(size: int, read) -> dict[str, tuple[int, int]]:
    """name -> (offset of its bytes, their number), by read(offset, length) of ranges only."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    k = tail.rfind(b"PK\5\6")
    if k < 0:
        raise ValueError("no end record of a ZIP")
    _, _, _, _, count, length, start, _ = struct.unpack("<4s4H2LH", tail[k : k + 22])
    if count == 0xFFFF or 0xFFFFFFFF in (length, start):
        locator = read(tail_at + k - 20, 20)
        if locator[:4] == b"PK\6\7":
            wide = read(struct.unpack("<4sLQL", locator)[2], 56)
            count, length, start = struct.unpack("<4sQ2H2L4Q", wide)[7:10]
    directory, at, out = read(start, length), 0, {}
    for _ in range(count):
        f = struct.unpack("<4s6H3L5H2L", directory[at : at + 46])
        if f[0] != b"PK\1\2":
            raise ValueError("a central directory is broken")
        method, packed, full, n, m, c, where = f[4], f[8], f[9], f[10], f[11], f[12], f[16]
        name = directory[at + 46 : at + 46 + n].decode()
        extra = directory[at + 46 + n : at + 46 + n + m]
        while len(extra) >= 4:
            tag, span = struct.unpack("<HH", extra[:4])
            if tag == 1:  # ZIP64: only what does not fit stands here, in this order
                values = list(struct.unpack(f"<{span // 8}Q", extra[4 : 4 + span // 8 * 8]))
                full = values.pop(0) if full == 0xFFFFFFFF else full
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                where = values.pop(0) if where == 0xFFFFFFFF else where
            extra = extra[4 + span :]
        if method:
            raise ValueError(f"{name} is not stored")
        local = read(where, 30)
        out[name] = where + 30 + sum(struct.unpack("<2H", local[26:30])), packed
        at += 46 + n + m + c
    return out


def _pack(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        records: list[bytes] = []
        index: list[bytes] = []
        done: list[tuple[str, int, int]] = []
        at = 0

        def close() -> None:
            nonlocal at
            if not records:
                return
            name = f"{path}/{task.partitionId()}-{task.taskAttemptId()}-{len(done)}.wacz"
            size = 0
            with fs.open_output_stream(f"{name}.part") as f:
                for x in zip_bytes([(MEMBER, records), (INDEX, index)]):
                    f.write(x)
                    size += len(x)
            fs.move(f"{name}.part", name)
            done.append((f"{folder}/{name.rsplit('/', 1)[1]}", size, len(records)))
            records.clear()
            index.clear()
            at = 0

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for page, url, payload, digest, size, kind, refers in zip(*(part.column(i).to_pylist() for i in range(7)), strict=True):
                    headers = [("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
                    if kind == "revisit":
                        headers += [("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    records.append(gzip.compress(record(kind, headers, payload or b""), 6, mtime=0))
                    index.append(json.dumps({"page": page, "offset": at, "length": len(records[-1])}).encode() + b"\n")
                    at += len(records[-1])
                    if at >= ARCHIVE_BYTES:
                        close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["archive", "bytes", "records"])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for archive, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, path = pyarrow.fs.FileSystem.from_uri(archive)
            with fs.open_input_file(path) as f:
                read = lambda at, n: f.read_at(n, at)
                members = zip_members(size, read)
                begin, _ = members[MEMBER]
                lines = read(*members[INDEX]).splitlines()
                for k in range(0, len(lines), 256):
                    cols: list[list] = [[] for _ in names]
                    for line in lines[k : k + 256]:
                        entry = json.loads(line)
                        headers, payload = parse_record(gzip.decompress(read(begin + entry["offset"], entry["length"])))
                        kind = headers["warc-type"]
                        if kind == "response":
                            n, digest, refers = len(payload), hashlib.sha256(payload).hexdigest(), None
                            if f"sha256:{digest}" != headers["warc-payload-digest"]:
                                raise ValueError(f"{archive}: a payload does not fit its digest")
                        else:
                            n, digest = int(headers["x-payload-length"]), headers["warc-payload-digest"].partition(":")[2]
                            refers = int(headers["warc-refers-to"][len("<urn:page:") : -1])
                        page = headers["warc-record-id"][len("<urn:page:") : -1]
                        for col, v in zip(cols, (int(page) if page else None, n, digest, kind, refers, payload if kind == "response" else None), strict=True):
                            col.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types, strict=True)], names=names)


def archive_pages(pages: DataFrame, folder: str = "", page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages; archive, bytes and records of each archive."""
    has_columns(pages, page_id, html)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), (F.col(url).cast("string") if url in pages.columns else F.lit(None).cast("string")).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    least = rows.filter(F.col("size") >= MINIMUM).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).filter("n > 1 and least is not null").select("digest", "least")
    joined = rows.join(least, "digest", "left")
    revisit = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    typed = joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("least")).alias("refers"))
    return typed.mapInArrow(_pack(folder or new_path(pages.sparkSession, "warc")), "archive string, bytes long, records long")


def read_archives(archives: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """archive, bytes -> page_id, payload_bytes, payload_digest, record_type, refers_to and payload of each record.

    There are as many tasks as the archives' bytes ask for, dealt by number, which adaptive execution does not merge
    (rows are few and small, what they name is not)."""
    found = archives.agg(F.count("*"), F.sum("bytes")).first()
    tasks = max(1, min(found[0], -(-(found[1] or 0) // task_bytes)))
    return archives.select("archive", "bytes").repartition(tasks).mapInArrow(_unpack, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
