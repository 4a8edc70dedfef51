"""Sentence files inside of tar archives: an index of their members, and the members that are wanted read by many tasks."""

from __future__ import annotations

import io
import tarfile
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an archive whose members one task reads; lines in a batch.
STRETCH, LINES = 32 << 20, 4096
INDEX = "archive string, split string, code string, offset bigint, size bigint"


def _open(path: str):
    """A stream of a file of any store that Arrow knows; what Spark writes as ``file:/x`` is ``/x``."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    if "://" in path:
        fs, inner = pafs.FileSystem.from_uri(path)
        return fs.open_input_file(inner)
    return pafs.LocalFileSystem().open_input_file(path)


def _wanted(name: str) -> tuple[str, str] | None:
    """(split, code) of a member ``.../SPLIT/CODE.SPLIT``."""
    parts = name.split("/")
    tail = f".{parts[-2]}" if len(parts) > 1 else None
    return (parts[-2], parts[-1].removesuffix(tail)) if tail and parts[-1].endswith(tail) else None


def _plain(stream) -> bool:
    """Whether it is a tar file as it is, in which members can be jumped to."""
    head = stream.read(512)
    stream.seek(0)
    return head[257:262] == b"ustar"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("archive", "split", "code", "offset", "size")
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    for batch in batches:
        for path in batch.column("archive").to_pylist():
            rows = []
            with _open(path) as stream:
                if _plain(stream):
                    with tarfile.open(fileobj=stream, mode="r:") as archive:  # headers alone are read
                        for member in archive:
                            found = _wanted(member.name) if member.isfile() else None
                            if found:
                                rows.append((path, *found, member.offset_data, member.size))
                            archive.members = []  # a table of all members is not kept
                else:
                    rows.append((path, None, None, None, None))
            for a in range(0, len(rows), LINES):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + LINES], strict=True), kinds, strict=True)], names)


def member_index(spark: SparkSession, path: str) -> DataFrame:
    """``archive, split, code, offset, size`` of the members ``.../SPLIT/CODE.SPLIT`` of the tar files that ``path`` names (a glob).

    Archives are indexed in tasks of their own, which read the members' headers alone. A packed archive (gz, bz2, xz), in
    which nothing can be jumped to, is one row with nulls.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"))
    return files.repartition("archive").mapInArrow(_index, INDEX)


class _Member(io.RawIOBase):
    """The bytes of one member of an open archive."""

    def __init__(self, stream, offset: int, size: int):
        self.stream, self.left = stream, size
        stream.seek(offset)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.stream.read(min(len(into), self.left))
        into[: len(data)] = data
        self.left -= len(data)
        return len(data)


def _lines(raw) -> Iterator[str]:
    """Trimmed NFC lines that are not blank; one line is held at a time."""
    for line in raw:
        for part in line.decode("utf-8").splitlines():
            if part.strip():
                yield unicodedata.normalize("NFC", part.strip())


def _members(path: str, offset, size, split, code, splits, codes):
    """(split, code, lines) of a row of the index; of a packed archive all members that are wanted, in one pass."""
    with _open(path) as stream:
        if offset is not None:
            yield split, code, _lines(io.BufferedReader(_Member(stream, offset, size)))
            return
        with tarfile.open(fileobj=stream, mode="r|*") as archive:
            for member in archive:
                found = _wanted(member.name) if member.isfile() else None
                if found and (splits is None or found[0] in splits) and (codes is None or found[1] in codes):
                    yield *found, _lines(archive.extractfile(member))
                archive.members = []


def _read(splits, codes):
    def run(batches):
        names, kinds = ("split", "code", "line", "text"), (pa.string(), pa.string(), pa.int32(), pa.string())
        for batch in batches:
            for row in batch.select(["archive", "offset", "size", "split", "code"]).to_pylist():
                for split, code, lines in _members(*row.values(), splits, codes):
                    held = []
                    for k, text in enumerate(lines, 1):
                        held.append((split, code, k, text))
                        if len(held) == LINES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return run


def read_members(index: DataFrame, splits: list[str] | None = None, codes: list[str] | None = None, stretch: int = STRETCH) -> DataFrame:
    """``split, code, line, text``: trimmed NFC lines of the members of the named splits and codes (all without names), numbered from 1 without blank ones.

    Members that are not wanted go from the index, so their bytes are never read. The others are dealt out by stretches
    of their archives, in the order in which they stand there; no task holds more than a batch of lines. A packed archive is one task.
    """
    wanted = F.lit(True)
    for column, values in (("split", splits), ("code", codes)):
        if values is not None:
            wanted = wanted & (F.col("offset").isNull() | F.col(column).isin(*values))
    parts = index.where(wanted).withColumn("stretch", F.floor(F.coalesce("offset", F.lit(0)) / stretch))
    # a number of partitions that follows the session's setting and is not merged: rows of the index are small, what they stand for is not
    cores = max(index.sparkSession.sparkContext.defaultParallelism, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = parts.repartition(cores, "archive", "stretch").sortWithinPartitions("archive", "offset").drop("stretch")
    return dealt.mapInArrow(_read(splits, codes), "split string, code string, line int, text string")
