"""WARC archives: gzip members written through Spark, and a reader that splits files anywhere.

Writing: a task makes one gzip member per record, and Spark's text writer stores them, so its commit
protocol covers lost executors and repeated tasks.  A member ends in the highest byte of its length,
which is 0 below 16 MiB (a longer record is followed by an empty member); that byte is left to the
writer as its line separator, so the files are plain concatenated gzip.

Reading: Spark's text reader scans byte ranges with the gzip magic as its separator.  A range owns the
candidates that start inside.  A candidate is a record when it inflates, passes its checksum and starts
with a WARC header; magic bytes by chance inside a record cut it in pieces, and the pieces are put
together again, across ranges if need be.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, uri string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def gzip_member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def member(record: dict, level: int) -> bytes:
    """A record as gzip, less the 0 at its end."""
    payload = b"" if record["refers_to"] is not None else record["payload"] or b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = [
        "WARC/1.1", f"WARC-Type: {record['record_type']}", f"WARC-Record-ID: <{record['record_id']}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{record['payload_digest']}",
        f"WARC-Payload-Length: {record['payload_bytes']}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if record["uri"] is not None:
        head.append("WARC-Target-URI: " + record["uri"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if record["refers_to"] is not None:
        head += [f"WARC-Refers-To: <{record['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    packed = gzip_member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", level)
    if packed[-1]:
        packed += gzip_member(b"", level)
    return packed[:-1]


def write_warc(records: DataFrame, path: str, level: int = 5) -> None:
    """Write ``records(record_id, uri, record_type, refers_to, payload_digest, payload_bytes, payload)``.

    A record with ``refers_to`` is stored without its payload.  Null payloads are empty, null uris left out.
    """
    def run(batches):
        for batch in batches:
            out = [member(r, level) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    packed = records.mapInArrow(run, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\x00").text(path)


def parse(data: bytes) -> dict | None:
    """The record in an inflated member, or None if it holds none."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        return None
    fields = {k.strip().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    block = rest[: int(fields.get(b"content-length", len(rest)))]
    kind = fields.get(b"warc-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if fields.get(b"content-type", "").startswith("application/http") else block
    uri = fields.get(b"warc-target-uri")
    stored = kind != "revisit"
    said = fields.get(b"warc-payload-digest", "sha1:").partition(":")[2]
    return {
        "record_id": bare(b"warc-record-id"), "record_type": kind, "refers_to": bare(b"warc-refers-to"),
        "uri": uri and uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "payload_digest": hashlib.sha1(payload).hexdigest() if stored else said,
        "payload_bytes": len(payload) if stored else int(fields.get(b"warc-payload-length", 0)),
        "payload": payload if stored else None,
    }


class Candidate:
    """A member that may still lack its end, and the pieces it was given."""

    def __init__(self):
        self.pieces, self.unpacker, self.out, self.done, self.bad = [], zlib.decompressobj(31), [], False, False

    def feed(self, piece: bytes) -> None:
        self.pieces.append(piece)
        try:
            made = self.unpacker.decompress(MAGIC + piece)
        except zlib.error:
            self.bad = True
            return
        if made:
            self.out.append(made)
        self.done = self.unpacker.eof
        self.bad = bool(self.out) and not b"WARC/".startswith(b"".join(self.out[:5])[:5])

    def record(self) -> dict | None:
        return parse(b"".join(self.out))


def walk(pieces: Iterator[bytes], last: bool = False) -> Iterator[tuple[str, dict | list[bytes]]]:
    """Records of one byte range, and the pieces at its two ends that belong to other ranges.

    A piece that is no start goes to the range's head as long as no record has ended here; what a failed candidate
    was given is tried again from its second piece.  With ``last`` a candidate without end has failed, too.
    """
    head, waiting, now, begun = [], [], None, False

    def rejected() -> None:
        nonlocal now
        if not begun:
            head.append(now.pieces[0])
        waiting[:0] = now.pieces[1:]
        now = None

    source = iter(pieces)
    while True:
        piece = waiting.pop(0) if waiting else next(source, None)
        if piece is None:
            if now is None or not last:
                break
            rejected()
            continue
        now = now or Candidate()
        now.feed(piece)
        if now.bad:
            rejected()
        elif now.done:
            record = now.record()
            if record is not None:
                yield "record", record
            now, begun = None, True
    tail = now.pieces if now is not None else []
    if not begun:
        head, tail = head + tail, []
    if head:
        yield "head", head
    if tail:
        yield "tail", tail


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else None


_ARROW = pa.schema(
    [("kind", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("pieces", pa.list_(pa.binary()))]
    + [(c.split()[0], {"long": pa.int64(), "binary": pa.binary()}.get(c.split()[1], pa.string())) for c in RECORD.split(", ")]
)
_NAMES = _ARROW.names[4:]


def _scan(batches):
    from itertools import groupby

    def pieces():
        for batch in batches:
            yield from zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), batch.column("value").to_pylist(), strict=True)

    rows, size = [], 0
    for (file, start), group in groupby(pieces(), lambda x: x[:2]):
        parts = (x[2] for x in group)
        if start == 0:
            next(parts, None)  # what stands before the first magic of a file
        for kind, x in walk(parts):
            record = x if kind == "record" else {}
            rows.append((kind, file, start, None if kind == "record" else x, *[record.get(c) for c in _NAMES]))
            size += len(record.get("payload") or b"")
            if len(rows) >= 1000 or size > 1 << 23:
                yield _columns(rows, _ARROW)
                rows, size = [], 0
    if rows:
        yield _columns(rows, _ARROW)


def _stitch(frame):
    import pandas as pd

    frame = frame.sort_values(["start", "kind"])  # the head of a range comes before its tail
    pieces = (piece for row in frame["pieces"] for piece in row)
    out = [record for kind, record in walk(pieces, last=True) if kind == "record"]
    return pd.DataFrame(out, columns=_NAMES)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the gzip archives under ``path``, in no order, with the columns of ``write_warc``.

    Digest and length of a stored payload are computed from it; a revisit has those of its headers and a null
    payload.  Members that do not inflate, fail their checksum or hold no WARC header are passed over.  Pieces
    that a range could not place are gathered by file: there are some only where magic bytes stand by chance
    inside a record that goes over the end of a range.  Files named ``*.gz`` are refused.
    """
    named = [f for f in spark.read.text(path).inputFiles() if f.lower().endswith(".gz")]
    if named:
        raise ValueError(f"files named *.gz are inflated by Spark before they can be split; store them without it: {named[0]}")
    lines = (
        spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
        .select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    )
    scanned = lines.mapInArrow(_scan, f"kind string, file string, start long, pieces array<binary>, {RECORD}")
    whole = scanned.filter("kind = 'record'").select(*_NAMES)
    loose = scanned.filter("kind <> 'record'").select("file", "start", "kind", "pieces")
    return whole.unionByName(loose.groupBy("file").applyInPandas(_stitch, RECORD))


def with_revisits(pages: DataFrame, key: str, url: str, payload: Column, min_bytes: int = 1000) -> DataFrame:
    """Records of ``pages`` for ``write_warc``: of equal payloads of ``min_bytes`` the one with the largest key is stored.

    Null payloads are empty.  Rows that share the largest key are all stored; a null key is never the largest
    unless all are null.
    """
    data = F.coalesce(payload.cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("uri"), data.alias("payload")).withColumns(
        {"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    small = rows.select("k", "payload_digest", "payload_bytes").filter(F.col("payload_bytes") >= min_bytes)
    first = small.groupBy("payload_digest").agg(F.max("k").alias("to"), F.count("*").alias("n")).filter("n > 1 and to is not null")
    joined = rows.join(first.drop("n"), "payload_digest", "left")
    again = F.col("to").isNotNull() & ~F.col("k").eqNullSafe(F.col("to"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return joined.select(
        name("k").alias("record_id"), "uri", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, name("to")).alias("refers_to"), "payload_digest", "payload_bytes", "payload",
    )
