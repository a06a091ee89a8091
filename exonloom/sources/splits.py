"""Data sources that read files by byte ranges: FASTA of any line length and block-compressed text.

Both are Python data sources.  A partition is a range of bytes of one file; a task opens the file and reads what its
range owns, so neither a chromosome on one line nor a compressed file is ever one row or one task.  Files are opened
through ``pyarrow.fs``: a path may be local, ``file:``, ``s3://``, ``gs://`` or ``hdfs://``, one file or a folder of files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from exonloom.session import cut_lineage

DEFAULT_SPLIT = 32 << 20
#: Small ranges of FASTA are read by one task until they are so many bytes.
TASK_BYTES = 4 << 20
#: Bytes that a task reads at once, bases of one row, and lines of one batch.
WINDOW, PIECE, LINES = 1 << 20, 1 << 14, 1 << 14


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def files_under(path: str) -> list[tuple[str, int]]:
    """``(path, size)`` of the data files at ``path``, in order of their names; hidden files are left out."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File]
    prefix = path[: path.index(inner)] if inner in path else ""
    return sorted((prefix + f.path, f.size) for f in found if f.base_name[:1] not in "._")


@dataclass
class Range(InputPartition):
    """Bytes ``[begin, end)`` of a file."""

    path: str
    begin: int
    end: int

    def __post_init__(self) -> None:
        super().__init__((self.path, self.begin))


@dataclass
class Task(InputPartition):
    """Ranges that one task reads one after another."""

    ranges: tuple[Range, ...]

    def __post_init__(self) -> None:
        super().__init__(self.ranges)


class Ranges(DataSourceReader):
    """Ranges of at most ``splitBytes`` bytes over the files at ``path``; a task reads up to ``task_bytes`` of them, or one."""

    task_bytes = 0

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", DEFAULT_SPLIT))
        if self.split < 1:
            raise ValueError("splitBytes must be positive")

    def ranges(self) -> list[Range]:
        return [Range(n, at, min(at + self.split, size)) for n, size in files_under(self.path) for at in range(0, size, self.split)]

    def partitions(self) -> list[Task]:
        ranges, most = self.ranges(), max(self.task_bytes // self.split, 1)
        return [Task(tuple(ranges[i : i + most])) for i in range(0, len(ranges), most)] or [Task(())]

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges:
            yield from self.read_range(part)


class Bytes:
    """An open file that is read by place."""

    def __init__(self, path: str):
        system, inner = opened(path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()

    def at(self, begin: int, length: int) -> bytes:
        return self.file.read_at(max(min(length, self.size - begin), 0), begin)


# ---------------------------------------------------------------- FASTA

#: Rows of a range: the end of a line that began before it, bases, a header, and how the range ends.
FRAGMENT, BASES, HEADER, END = range(4)
_PARTS = "file string, begin bigint, no int, kind int, header_at bigint, name string, bases string, in_header boolean"


def fasta_parts(path: str, begin: int, end: int) -> Iterator[tuple]:
    """``(kind, header_at, name, bases, in_header)`` of a range, in order.

    What stands before the first new line is a fragment, as only earlier ranges can tell whether it is part of a header.
    A header belongs to the range where it begins, which reads to its end.  ``in_header`` of the last row says
    whether the range ends inside one; null if the whole range is a fragment.
    """
    source, at = Bytes(path), begin
    state = "line" if not begin or source.at(begin - 1, 1) == b"\n" else "fragment"
    header_at, name = -1, b""
    while at < end:
        block, i = source.at(at, min(WINDOW, end - at)), 0
        if not block:
            break
        while i < len(block):
            if state == "line":
                state = "header" if block[i : i + 1] == b">" else "bases"
                if state == "header":
                    header_at, name, i = at + i, b"", i + 1
                continue
            if state == "bases":
                stop = block.find(b"\n>", i) + 1 or len(block)
                kept = block[i:stop].translate(None, b"\r\n")
                for k in range(0, len(kept), PIECE):
                    yield BASES, None, None, kept[k : k + PIECE].decode("ascii", "replace"), None
            else:
                stop = block.find(b"\n", i) + 1 or len(block)
                if state == "header":
                    name += block[i:stop]
                else:
                    kept = block[i:stop].translate(None, b"\r\n")
                    for k in range(0, len(kept), PIECE):
                        yield FRAGMENT, None, None, kept[k : k + PIECE].decode("ascii", "replace"), None
            ended = block[stop - 1 : stop] == b"\n"
            if state == "header" and ended:
                yield HEADER, header_at, _first_word(name), None, None
            state, i = "line" if ended else state, stop
        at += len(block)
    if state == "header":
        while b"\n" not in name and (more := source.at(at, 4096)):
            name, at = name + more, at + len(more)
        yield HEADER, header_at, _first_word(name.split(b"\n", 1)[0]), None, None
    yield END, None, None, None, None if state == "fragment" else state == "header"


def _first_word(header: bytes) -> str:
    return (header.decode("utf-8", "replace").split() or [""])[0]


class FastaRanges(DataSource):
    """``spark.read.format("fasta_ranges").option("splitBytes", n).load(path)``: the parts of every range."""

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return _PARTS

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)


class FastaReader(Ranges):
    task_bytes = TASK_BYTES

    def read_range(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        names = [c.split()[0] for c in _PARTS.split(", ")]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for no, (kind, header_at, name, bases, in_header) in enumerate(fasta_parts(partition.path, partition.begin, partition.end)):
            rows.append((partition.path, partition.begin, no, kind, header_at, name, bases, in_header))
            if len(rows) == 256:
                yield batch()
                rows = []
        if rows:
            yield batch()


def read_genome_ranges(spark: SparkSession, path: str, chunk: int = 4096, split_bytes: int = DEFAULT_SPLIT) -> DataFrame:
    """``(chrom, chunk_no, bases, chrom_len)`` like ``read_genome``, for files of any line length.

    Files are read once, by byte ranges.  A range hands on the last header that it holds, the bases after it, and
    whether it ends in one; from these few rows per file every piece gets its record and its offset, and the pieces
    of a chunk are put together.  Bases before the first header of a file belong to no record.
    """
    spark.dataSource.register(FastaRanges)
    parts = cut_lineage(spark.read.format("fasta_ranges").option("splitBytes", split_bytes).load(path))
    in_range = Window.partitionBy("file", "begin").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    counted = parts.withColumn("size", F.when(F.col("kind") == BASES, F.length("bases")).otherwise(0).cast("bigint"))
    # what a range hands on
    mark = F.when(F.col("kind") == HEADER, F.struct("no", "header_at", "name"))
    ends = counted.withColumn("last", F.max(mark).over(Window.partitionBy("file", "begin"))).groupBy("file", "begin", "last").agg(
        F.sum(F.when(F.col("last").isNull() | (F.col("no") > F.col("last.no")), F.col("size")).otherwise(0)).alias("after"),
        F.sum(F.when(F.col("kind") == FRAGMENT, F.length("bases")).otherwise(0)).alias("fragment"),
        F.max("in_header").alias("in_header"),
    )
    earlier = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, 0)
    known = ends.withColumn("opens_in_header", F.coalesce(F.last("in_header", True).over(earlier), F.lit(False)))
    known = known.withColumn("added", F.when(F.col("opens_in_header"), 0).otherwise(F.col("fragment")))
    record = F.last("last", True).over(earlier)
    # bases since the last header: those of all ranges up to here less those up to the range of that header
    run = known.withColumns({"record": record, "total": F.sum(F.col("after") + F.when(F.col("last").isNull(), F.col("added")).otherwise(0)).over(upto)})
    run = run.withColumn("base", F.coalesce(F.last(F.when(F.col("last").isNotNull(), F.col("total") - F.col("after")), True).over(earlier), F.lit(0)))
    start = F.coalesce(F.lag("total").over(Window.partitionBy("file").orderBy("begin")), F.lit(0)) - F.col("base")
    opened_at = run.select("file", "begin", "opens_in_header", F.col("record.header_at").alias("r_at"), F.col("record.name").alias("r_name"), start.alias("r_start"))
    # place of every piece
    within = F.max(mark).over(in_range)
    kept = F.when((F.col("kind") == FRAGMENT) & ~F.col("opens_in_header"), F.length("bases")).otherwise(F.col("size")).cast("bigint")
    placed = counted.join(opened_at, ["file", "begin"]).withColumns({"own": within, "kept": kept})
    of_own = Window.partitionBy("file", "begin", "own.no").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("kept").over(of_own), F.lit(0))
    placed = placed.select(
        "file", F.coalesce("own.header_at", "r_at").alias("record"), F.coalesce("own.name", "r_name").alias("chrom"), "bases", "kept",
        (before + F.when(F.col("own").isNull(), F.col("r_start")).otherwise(0)).alias("at"),
    ).filter("kept > 0 and record is not null")
    # a piece is cut at the borders of chunks
    nth = lambda at: F.floor(at / F.lit(chunk)).cast("bigint")
    cut = placed.withColumn("chunk_no", F.explode(F.sequence(nth(F.col("at")), nth(F.col("at") + F.col("kept") - 1))))
    lo = F.greatest(F.col("chunk_no") * chunk - F.col("at"), F.lit(0))
    hi = F.least((F.col("chunk_no") + 1) * chunk - F.col("at"), F.col("kept"))
    pieces = cut.select("file", "record", "chrom", "chunk_no", F.struct("at", F.substring("bases", lo.cast("int") + 1, (hi - lo).cast("int")).alias("b")).alias("p"))
    chunks = pieces.groupBy("file", "record", "chrom", "chunk_no").agg(F.array_sort(F.collect_list("p")).alias("p"))  # a chunk at most
    sizes = placed.groupBy("file", "record").agg(F.sum("kept").alias("chrom_len"))
    return chunks.join(sizes, ["file", "record"]).select(
        "chrom", "chunk_no", F.array_join(F.transform("p", lambda x: x["b"]), "").alias("bases"), "chrom_len"
    )


# ---------------------------------------------------------------- block-compressed text

_BLOCK_START = b"\x1f\x8b\x08\x04"


def block_size(head: bytes) -> int:
    """Compressed size of the block that ``head`` begins, or 0 if it begins none."""
    if len(head) < 18 or head[:4] != _BLOCK_START:
        return 0
    extra = struct.unpack_from("<H", head, 10)[0]
    i, stop = 12, 12 + extra
    while i + 4 <= min(stop, len(head)):
        length = struct.unpack_from("<H", head, i + 2)[0]
        if head[i : i + 2] == b"BC" and length == 2 and i + 6 <= len(head):
            return struct.unpack_from("<H", head, i + 4)[0] + 1
        i += 4 + length
    return 0


def inflated(source: Bytes, at: int) -> tuple[bytes, int] | None:
    """Text and compressed size of the block at ``at``; None if no sound block begins there."""
    size = block_size(source.at(at, 1 << 10))
    if not size:
        return None
    block = source.at(at, size)
    start = 12 + struct.unpack_from("<H", block, 10)[0]
    try:
        text = zlib.decompress(block[start:-8], -15)
    except zlib.error:
        return None
    sound = len(block) == size and struct.unpack("<II", block[-8:]) == (zlib.crc32(text), len(text))
    return (text, size) if sound else None


def first_block(source: Bytes, begin: int, end: int) -> int:
    """Where the first sound block at or after ``begin`` starts, -1 if none starts before ``end``."""
    at = begin
    while at < end:
        window = source.at(at, min(WINDOW, end - at) + 3)
        i = window.find(_BLOCK_START)
        while i >= 0 and at + i < end:
            if inflated(source, at + i):
                return at + i
            i = window.find(_BLOCK_START, i + 1)
        at += WINDOW
    return -1


def block_lines(path: str, begin: int, end: int) -> Iterator[tuple[str, int]]:
    """``(line, voffset)`` of the lines that a range owns.

    A range owns the blocks that start in it, and the lines that start in these blocks or right behind them, but for
    what stands before the first new line; the first range of a file owns that, too.  The last line is read on in the
    blocks that follow.  A virtual offset is the place of the block, shifted by 16 bits, plus that of the line in it.
    """
    source = Bytes(path)
    at = first_block(source, begin, end)
    if begin == 0 and at != 0 and source.size:
        raise ValueError(f"{path} is not block-compressed")
    if at < 0:
        return
    skipping, line, place = begin > 0, [], -1
    while at < source.size:
        got = inflated(source, at)
        if got is None:
            raise ValueError(f"{path}: no sound block at {at}")
        text, size = got
        owned, i = at < end, 0
        if not owned and skipping:
            return  # no line starts here
        while i < len(text):
            stop = text.find(b"\n", i)
            if skipping:
                if stop < 0:
                    break
                skipping, i = False, stop + 1
                continue
            if place < 0:
                place = at << 16 | i
            line.append(text[i:] if stop < 0 else text[i:stop])
            if stop < 0:
                break
            yield b"".join(line).decode("utf-8", "replace").removesuffix("\r"), place
            line, place, i = [], -1, stop + 1
            if not owned:
                return
        at += size
    if line:
        yield b"".join(line).decode("utf-8", "replace").removesuffix("\r"), place


class BlockLines(DataSource):
    """``spark.read.format("block_lines").load(path)``: ``value``, ``file`` and ``voffset`` of every line."""

    @classmethod
    def name(cls) -> str:
        return "block_lines"

    def schema(self) -> str:
        return "value string, file string, voffset bigint"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(self.options)


class BlockReader(Ranges):
    def read_range(self, partition: Range) -> Iterator[pa.RecordBatch]:
        lines: list[tuple[str, int]] = []

        def batch() -> pa.RecordBatch:
            values, places = zip(*lines)
            return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([partition.path] * len(lines), pa.string()), pa.array(places, pa.int64())],
                                              names=["value", "file", "voffset"])

        for line in block_lines(partition.path, partition.begin, partition.end):
            lines.append(line)
            if len(lines) == LINES:
                yield batch()
                lines = []
        if lines:
            yield batch()


def read_block_lines(spark: SparkSession, path: str, split_bytes: int = DEFAULT_SPLIT) -> DataFrame:
    """Lines of block-compressed files (``.vcf.gz``, ``.bed.gz``), read by ranges that meet at no line's cost."""
    spark.dataSource.register(BlockLines)
    return spark.read.format("block_lines").option("splitBytes", split_bytes).load(path)
