"""A file sink for text formats whose every file begins with header lines, plain or block-compressed.

``df.write.format("framed_text").option("header", json.dumps(lines)).mode("overwrite").save(path)`` writes the
column ``value``.  A task writes one file under a hidden name; only when all tasks have succeeded are the files given
their names, and files of failed or repeated attempts are removed.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from exonloom.sources.splits import opened

#: Bytes of text in one compressed block, and the block that ends a file (fixed values of the format).
BLOCK_TEXT = 0xFF00
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def compressed(text: bytes) -> bytes:
    """One block of the block-compressed format."""
    made = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = made.compress(text) + made.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    name: str
    rows: int


class FramedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framed_text"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FramedWriter(self.options, [f.name for f in schema.fields], overwrite)


class FramedWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        if columns != ["value"]:
            raise ValueError("the rows must have the one column value")
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.header = json.loads(options.get("header", "[]"))
        self.blocks = options.get("compression", "none") == "blocks"
        self.suffix = options.get("suffix", ".txt")
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        system, folder = opened(self.path)
        name = f"part-{part:05d}-{self.run}{self.suffix}"
        hidden = f"{folder}/_attempt-{attempt}-{name}"
        system.create_dir(folder, recursive=True)
        rows = 0
        with system.open_output_stream(hidden, compression=None) as out:
            waiting = bytearray("".join(f"{h}\n" for h in self.header).encode())
            for row in iterator:
                waiting += (row[0] or "").encode() + b"\n"
                rows += 1
                if len(waiting) >= BLOCK_TEXT:
                    self._put(out, waiting)
            self._put(out, waiting, True)
            if self.blocks:
                out.write(LAST_BLOCK)
        return Written(hidden, name, rows)

    def _put(self, out, waiting: bytearray, all_of_it: bool = False) -> None:
        """Write whole blocks of what waits, or all."""
        while len(waiting) >= BLOCK_TEXT or (all_of_it and waiting):
            text = bytes(waiting[:BLOCK_TEXT])
            out.write(compressed(text) if self.blocks else text)
            del waiting[:BLOCK_TEXT]

    def _hidden(self) -> tuple[fs.FileSystem, list[str]]:
        """Files of this run's attempts that have no name yet."""
        system, folder = opened(self.path)
        if system.get_file_info(folder).type != fs.FileType.Directory:
            return system, []
        return system, [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("_attempt-") and self.run in f.base_name]

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        kept = [m for m in messages if m is not None]
        system.create_dir(folder, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and f.base_name[:1] not in "._"]
        for m in kept:
            system.move(m.hidden, f"{folder}/{m.name}")
        if self.overwrite:
            for f in old:
                system.delete_file(f)
        for f in self._hidden()[1]:
            system.delete_file(f)
        with system.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(json.dumps({"files": len(kept), "rows": sum(m.rows for m in kept)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, left = self._hidden()
        for f in left:
            system.delete_file(f)


def write_framed(lines: DataFrame, path: str, header: Sequence[str] = (), blocks: bool = False, suffix: str = ".txt") -> None:
    """Write ``lines(value)`` below ``path``, every file with ``header`` first; ``blocks`` compresses in blocks."""
    lines.sparkSession.dataSource.register(FramedText)
    writer = lines.select(F.col("value").cast("string")).write.format("framed_text").mode("overwrite")
    writer.option("header", json.dumps(list(header))).option("compression", "blocks" if blocks else "none").option("suffix", suffix).save(path)


def write_vcf(vcf: DataFrame, path: str, header: Sequence[str], blocks: bool = True) -> None:
    """Records of ``parse_vcf`` as VCF files with their header lines, ``.vcf.gz`` unless ``blocks`` is off."""
    from exonloom.sources.variants import vcf_lines

    write_framed(vcf_lines(vcf), path, header, blocks, ".vcf.gz" if blocks else ".vcf")


def write_bed_track(df: DataFrame, path: str, track: str, **options) -> None:
    """BED files that each begin with a ``track`` line; ``options`` go to ``bed_frame``."""
    from exonloom.sources.sinks import bed_frame

    rows = bed_frame(df, **options)
    write_framed(rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value")), path, [f"track {track}"], suffix=".bed")
