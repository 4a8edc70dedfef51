"""WARC archives as a PySpark data source: writer, planned reader, revisit records.

Executors write and read archives themselves, so the folder must be one that all of them
reach: a path, ``file:`` or any scheme that ``pyarrow.fs`` opens. Beside each archive lies an index,
an Arrow file with one batch for each part of the archive that a task reads: the headers
that predicates can name, and where each record begins. Records that a predicate rejects are
neither read nor unpacked.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import shared_dir, staged, table

MIN_REVISIT_BYTES = 1000
#: Repeated digests are broadcast up to so many bytes.
BROADCAST_BYTES = 64 << 20
#: Bytes of an archive for one read task, a batch of its index.
SPLIT_BYTES = 32 << 20
FILE_BYTES = 256 << 20
BLOCK = 1 << 16
#: What the list of files of a commit is called, before a number of its own.
LISTS = "_files-"
RECORD = "page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, content_type string, payload binary"
#: Columns that a predicate can be pushed to, with the header that holds each.
HEADERS = {"page_id": "x-page-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "x-refers-to-page", "content_type": "content-type"}


def filesystem(path: str):
    """(file system, path in it) of a path or URI."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def escaped(url: str | None) -> str:
    """A URL that fits into a header line."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "about:blank")


def record_bytes(row) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the full length, and no payload."""
    body = (row.payload or "").encode() if row.record_type == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n\r\n".encode()
    name = lambda k: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{k}").urn
    head = ["WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: <{name(row.page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {escaped(row.url)}", f"WARC-Payload-Digest: sha1:{row.payload_digest}", f"Content-Type: {CONTENT}"]
    if row.page_id is not None:
        head.append(f"X-Page-Id: {row.page_id}")
    if row.record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{name(row.refers_to)}>", f"X-Refers-To-Page: {row.refers_to}"]
        if row.refers_url:
            head.append(f"WARC-Refers-To-Target-URI: {escaped(row.refers_url)}")
    head.append(f"Content-Length: {len(http) + len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


class Archive:
    """An archive and its index in the making."""

    def __init__(self, fs, root: str, packed: bool):
        self.name, self.size, self.parts, self.begin = f"part-{uuid.uuid4().hex}.warc{'.gz' * packed}", 0, 0, 0
        self.out = fs.open_output_stream(f"{root}/{self.name}", compression=None)
        self.side = fs.open_output_stream(f"{root}/{self.name}{INDEX}", compression=None)
        self.index, self.rows = pa.ipc.new_file(self.side, ENTRY), []

    def add(self, row, data: bytes) -> None:
        if self.size - self.begin >= SPLIT_BYTES:
            self.flush()
        refers = row.refers_to if row.record_type == "revisit" else None
        self.rows.append((row.page_id, row.record_type, escaped(row.url), row.payload_digest, refers, CONTENT, self.size, len(data)))
        self.out.write(data)
        self.size += len(data)

    def flush(self) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), ENTRY, strict=True)], schema=ENTRY))
        self.rows, self.begin, self.parts = [], self.size, self.parts + 1

    def close(self) -> dict:
        self.flush()
        self.index.close()
        self.side.close()
        self.out.close()
        return {"name": self.name, "parts": self.parts}


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceWriter):
    """Each task attempt writes files of its own; the commit lists those that count, in a list of its own.

    Files of lost or repeated attempts stay unlisted and are not read. A folder written to again keeps the archives of
    earlier commits.
    """

    def __init__(self, options):
        self.path, self.gzip = options["path"], options.get("compression", "gzip") == "gzip"

    def write(self, rows):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        done, archive = [], None
        for row in rows:
            data = record_bytes(row)
            if self.gzip:
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = z.compress(data) + z.flush()
            archive = archive or Archive(fs, root, self.gzip)
            archive.add(row, data)
            if archive.size >= FILE_BYTES:
                done.append(archive.close())
                archive = None
        if archive:
            done.append(archive.close())
        return Written(done)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        with fs.open_output_stream(f"{root}/{LISTS}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(sorted(files, key=lambda f: f["name"])).encode())

    def abort(self, messages):
        fs, root = filesystem(self.path)
        for m in messages:
            for f in m.files if m else []:
                fs.delete_file(f"{root}/{f['name']}")
                fs.delete_file(f"{root}/{f['name']}{INDEX}")


@dataclass
class Part(InputPartition):
    """A batch of an archive's index, or an archive without one (-1)."""

    file: str
    part: int


class Blocks:
    """Bytes of an archive from ``start`` on, unpacked member by member if it is gzip."""

    def __init__(self, stream, start: int, packed: bool, indexed: bool = False):
        self.stream, self.packed, self.indexed, self.z, self.unpacked = stream, packed, indexed, None, 0
        self.seek(start)

    def seek(self, start: int) -> None:
        self.at, self.raw, self.out = start, b"", b""
        self.stream.seek(start)

    def member(self) -> bool:
        """Go to the next record; ``at`` is its offset. False at the end of the file."""
        if not self.packed:
            self.at = self.stream.tell() - len(self.out)
            if not self.out:
                self.out = self.stream.read(BLOCK)
            return bool(self.out)
        self.out = b""
        if not self.raw:
            self.raw = self.stream.read(BLOCK)
        self.at = self.stream.tell() - len(self.raw)
        self.z = zlib.decompressobj(31) if self.raw else None
        return bool(self.raw)

    def more(self) -> bytes:
        if not self.packed:
            return self.stream.read(BLOCK)
        while not self.z.eof:
            self.raw = self.raw or self.stream.read(BLOCK)
            if not self.raw:
                raise ValueError("truncated gzip member")
            got = self.z.decompress(self.raw, BLOCK)
            self.raw = self.z.unconsumed_tail if not self.z.eof else self.z.unused_data
            if got:
                self.unpacked += len(got)
                return got
        return b""

    def until(self, mark: bytes) -> bytes:
        """All up to ``mark``, which is passed over."""
        while (k := self.out.find(mark)) < 0:
            if not (got := self.more()):
                raise ValueError("truncated record header")
            self.out += got
        found, self.out = self.out[:k], self.out[k + len(mark) :]
        return found

    def take(self, n: int):
        while n > 0:
            if not self.out and not (got := self.more()):
                raise ValueError("truncated record block")
            elif not self.out:
                self.out = got
            part, self.out = self.out[:n], self.out[n:]
            n -= len(part)
            yield part

    def skip(self, n: int) -> None:
        """Pass over ``n`` bytes: by a seek if the archive is plain, else unpacked and let go."""
        if self.packed:
            for _ in self.take(n):
                pass
        elif n <= len(self.out):
            self.out = self.out[n:]
        else:
            self.stream.seek(n - len(self.out), 1)
            self.out = b""

    def end(self, unread: int, indexed: bool) -> None:
        """Leave a record of whose block ``unread`` bytes are left.

        With an index its end need not be found: ``at`` is then None, and the next record is sought."""
        if indexed and unread:
            self.at = None
        elif self.packed:  # the member's end is where the next one starts
            self.out = b""
            while self.more():
                pass
        else:
            self.skip(unread + 4)


def headers(raw: bytes) -> dict:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")) if _}


def matches(value, test) -> bool:
    if isinstance(test, IsNotNull):
        return value is not None
    if value is None:
        return False
    if isinstance(test, EqualTo):
        return value == test.value
    if isinstance(test, In):
        return value in test.value
    return {StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}[type(test)](value, test.value)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload, self.tests, self.unpacked = options["path"], options.get("payload", "full"), [], 0

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append(f)
            else:
                yield f

    def partitions(self):
        fs, root = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        lists = sorted(f.path for f in found if f.path.rpartition("/")[2].startswith(LISTS) and f.path.endswith(".json"))
        if not lists:  # archives from elsewhere: a task for each file
            return [Part(f.path, -1) for f in found if f.path.endswith((".warc", ".warc.gz"))]
        files = []
        for path in lists:
            with fs.open_input_stream(path) as f:
                files += json.loads(f.read())
        return [Part(f"{root}/{f['name']}", k) for f in files for k in range(f["parts"])]

    def read(self, part):
        if part is None:
            return
        fs, _ = filesystem(self.path)
        rows, held = [], 0
        with fs.open_input_file(part.file) as stream:
            src = Blocks(stream, 0, part.file.endswith(".gz"), part.part >= 0)
            for row, size in self.indexed(fs, part, src) if part.part >= 0 else self.scanned(src):
                rows.append(row)
                held += size + 200
                if held >= 4 << 20 or len(rows) >= 5000:
                    yield batch(rows)
                    rows, held = [], 0
            self.unpacked = src.unpacked
        if rows:
            yield batch(rows)

    def indexed(self, fs, part: Part, src: Blocks):
        """Records that the index lets pass; those between them are jumped over."""
        with fs.open_input_file(part.file + INDEX) as side:
            entries = pa.ipc.open_file(side).get_batch(part.part)
        keep = list(range(entries.num_rows))
        for t in self.tests:
            values = entries.column(t.attribute[0])
            keep = [i for i in keep if matches(values[i].as_py(), t)]
        begin, size = entries.column("begin").to_pylist(), entries.column("size").to_pylist()
        there = None
        for i in keep:
            if begin[i] != there:
                src.seek(begin[i])
            if not src.member():
                raise ValueError(f"{part.file} ends before its index")
            found = self.record(src)
            if found[0]:
                yield found
            there = begin[i] + size[i] if src.at is not None else None

    def scanned(self, src: Blocks):
        """All records in order: without an index a packed record has to be unpacked to be passed over."""
        while src.member():
            found = self.record(src)
            if found[0]:
                yield found

    def record(self, src: Blocks):
        """(row or None, bytes that it holds). The WARC header decides whether anything behind it is read."""
        first, _, rest = src.until(b"\r\n\r\n").partition(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {src.at}")
        head = headers(rest)
        left = int(head["content-length"])
        number = lambda k: int(head[k]) if head.get(k, "").lstrip("-").isdigit() else None
        row = {"page_id": number("x-page-id"), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "payload_bytes": None, "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": number("x-refers-to-page"), "content_type": head.get("content-type"), "payload": None}
        if not all(matches(row[t.attribute[0]], t) for t in self.tests):
            src.end(left, src.indexed)
            return None, 0
        held = 0
        if self.payload != "none" and (row["content_type"] or "").startswith("application/http"):
            raw = src.until(b"\r\n\r\n")
            left -= len(raw) + 4
            http = headers(raw)
            if row["record_type"] == "revisit":
                row["payload_bytes"] = int(http.get("content-length", 0))
            elif self.payload == "digest":
                sha, n = hashlib.sha1(), 0
                for part in src.take(left):
                    sha.update(part)
                    n += len(part)
                row |= {"payload_bytes": n, "payload_digest": sha.hexdigest()}
                left = 0
            else:
                row["payload"] = b"".join(src.take(left))
                row |= {"payload_bytes": len(row["payload"]), "payload_digest": hashlib.sha1(row["payload"]).hexdigest()}
                held, left = left, 0
        src.end(left, src.indexed)
        return row, held


INDEX, CONTENT = ".index", "application/http;msgtype=response"
ENTRY = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("content_type", pa.string()), ("begin", pa.int64()), ("size", pa.int64())])
ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("content_type", pa.string()), ("payload", pa.binary())])


def batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ARROW)


class WarcSource(DataSource):
    """``format("warc")``. Options: ``path``; ``compression`` gzip or none; ``payload`` full, digest or none."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """What to write for each page: null payloads are empty, equal large payloads are revisits.

    Of records with equal payloads of ``min_bytes`` and more, that with the largest page_id
    is the response (of rows with that id too, all are); a null page_id is below all others.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"), F.sha1(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    # Payloads stay where they are: digests alone are grouped. Few repeated ones are broadcast; many are
    # first joined to page ids and digests, so that pages of one digest are spread by their ids.
    same = ["payload_digest", "payload_bytes"]
    large = base.where(F.col("payload_bytes") >= min_bytes)
    repeated = large.groupBy(*same).agg(F.max("page_id").alias("first"), F.max_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("n"))
    repeated = staged(repeated.where("n > 1").drop("n"), "repeated")
    size = repeated.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("first_url"), F.lit(0)) + 128), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        joined = base.join(F.broadcast(repeated), same, "left")
    else:
        named = large.select("page_id", *same).distinct().join(repeated, same)
        named = named.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_d"), "first", "first_url")
        joined = base.join(named, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_d")), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id",
        "url",
        F.when(~again, F.col("payload")).alias("payload"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "payload_digest",
        "payload_bytes",
        F.when(again, F.col("first")).alias("refers_to"),
        F.when(again, F.col("first_url")).alias("refers_url"),
    )


def write_warc(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    spark = rows.sparkSession
    spark.dataSource.register(WarcSource)
    rows.write.format("warc").mode("append").option("path", path).option("compression", compression).save()


def read_warc(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    """Records of the archives below ``path``.

    A predicate on the record type or a header column is decided on the index: rejected records are
    neither read nor unpacked. Archives from elsewhere have no index; there it is decided on the
    WARC header, before the block behind it is read. ``payload`` says whether the block is kept, only measured and
    hashed, or passed over.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", payload).load(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(records(table(spark, sf_dir, "pages")), path)
    return read_warc(spark, path, "digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
w AS (SELECT page_id, payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM w
"""
