"""WARC archives: a writer with revisit records and a splittable reader.

Writing goes through Spark's text writer, so its commit protocol covers lost executors and any file system
works: every record is one gzip member, whose last byte (the high byte of the length field) is 0 and is supplied
as the line separator. A record of 16 MiB or more is followed by an empty member, which ends in 0 as well.

Reading cuts byte ranges at the gzip magic: a task owns the candidates that start inside its range, the last of
which may reach beyond it. A candidate counts as a member only if its header decodes. The magic can also occur inside
compressed data; such a false start is glued back to the member before it. Where that member began in an earlier
range, its parts meet in a grouping by file; these fragments are the only rows that are shuffled. Bytes that belong to no
whole member, and records without a type or a length, are rows of type ``damaged``.

Files whose names end in ``.gz`` are cut like others: see ``_RAW_GZ``.

Edge cases: a null html is an empty payload; a null url gives an empty target; a null id is written as ``null`` and
read back as null; repeated rows with the largest id are all responses; an empty table gives an empty archive,
read back as an empty table; whole members that are not WARC records are skipped; names of header fields are read in any case.
"""
from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm.arrow import small_batches
from tallyloom.llm.common import broadcast_below
from tallyloom.plans.small import scratch

MAGIC = b"\x1f\x8b\x08"
RECORD = "page_id bigint, record_type string, target_uri string, payload_digest string, payload_bytes bigint, " \
         "refers_to bigint, payload binary"
DAMAGED = "damaged"
_EMPTY_MEMBER = zlib.compress(b"", wbits=31)
#: The text source decompresses ``.gz`` files by their names and then cannot cut them. Hadoop looks a name up by the nearest known
#: ending before its own, read from behind, so one further ending next to ``.gz`` hides it: such files are read as they are, in ranges.
#: Spark's shaded Hadoop client has the option under a longer name.
_RAW_GZ = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
           "io.compress.passthrough.extension": ".\x01.gz",
           "org.apache.hadoop.shaded.io.compress.passthrough.extension": ".\x01.gz"}


def member(data: bytes) -> bytes:
    """A gzip member, or two, whose last byte is 0."""
    packed = zlib.compress(data, 6, wbits=31)
    return packed if packed[-1] == 0 else packed + _EMPTY_MEMBER


def record_bytes(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record: the HTTP answer with its payload, or for a revisit only its head."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = block if revisit else block + payload
    known = "null" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{known}>",
            f"WARC-Date: {date}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, min_payload: int = 0, date: str = "1970-01-01T00:00:00Z", key: str = "page_id",
               url: str = "url", html: str = "html") -> None:
    """Write a record per row to gzip files under ``path``. Of equal payloads of ``min_payload`` bytes or more the row
    with the largest id is the response. Only ids and digests are grouped by payload; the revisits are written to the shared
    folder and, up to a counted size, broadcast, so payloads stay where they are read."""
    small_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                        payload.alias("payload"))
    digests = rows.where(F.length("payload") >= min_payload).select("id", F.sha1("payload").alias("digest"))
    copies = (digests.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
              .where("n > 1 and refers_to is not null").drop("n"))
    revisits = (digests.join(copies, "digest").where("id is null or id <> refers_to")
                .select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to").distinct())
    def pack(ids: pa.Array, urls: pa.Array, payloads: pa.Array, refers: pa.Array) -> pa.Array:
        out = []
        for i, u, p, r in zip(ids, urls, payloads, refers):
            refers_to = r.as_py()
            out.append(member(record_bytes(i.as_py(), u.as_py(), p.as_py(), refers_to, refers_to is not None, date))[:-1])
        return pa.array(out, pa.binary())

    packed = F.arrow_udf(pack, "binary")("id", "url", "payload", "refers_to")
    with scratch(revisits, "warc-revisits") as known:
        same = rows["id"].eqNullSafe(F.col("r_id")) & (F.sha1("payload") == F.col("r_digest"))
        (rows.join(broadcast_below(known), same, "left").select(packed.cast("string").alias("value"))
         .write.option("lineSep", "\0").text(path))


def _head(candidate: bytes) -> str:
    """``record``, ``other`` (a whole member that is no record) or ``false`` (not a member)."""
    stream = zlib.decompressobj(31)
    try:
        start = stream.decompress(candidate, 64)
        if start.startswith(b"WARC/"):
            return "record"
        stream.decompress(stream.unconsumed_tail)
        return "other" if stream.eof else "false"
    except zlib.error:
        return "false"


def _unpack(packed: bytes) -> tuple[list[bytes], bytes]:
    """The records among the whole members, and the bytes of a cut off or damaged member. Zeros between members are padding."""
    records: list[bytes] = []
    while packed:
        stream = zlib.decompressobj(31)
        try:
            data = stream.decompress(packed)
        except zlib.error:
            break
        if not stream.eof:
            break
        if data.startswith(b"WARC/"):
            records.append(data)
        packed = stream.unused_data.lstrip(b"\0")
    return records, packed


class _Range:
    """Glues the candidates of one byte range to members."""

    def __init__(self, file: str, start: int, length: int):
        self.file, self.start, self.end = file, start, start + length
        self.leading: list[bytes] = []  # false starts before the first member: parts of an earlier range's
        self.parts: list[bytes] | None = None
        self.first = start == 0  # what stands before the first magic of a file

    def add(self, piece: bytes) -> bytes | None:
        """The member that this piece completes, if any."""
        if self.first:
            self.first = False
            if piece.strip(b"\0"):
                self.leading.append(piece)
            return None
        candidate = MAGIC + piece
        kind = _head(candidate)
        if kind == "false":
            (self.leading if self.parts is None else self.parts).append(candidate)
            return None
        done, self.parts = self.parts, [candidate] if kind == "record" else []
        return b"".join(done) if done else None

    def close(self) -> bytes | None:
        return b"".join(self.parts) if self.parts else None


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Range, bytes | None, bool]]:
    """Of every range its members; the last with True."""
    now = None
    for batch in batches:
        for piece, file, start, length in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or (now.file, now.start) != (file, start):
                if now is not None:
                    yield now, now.close(), True
                now = _Range(file, start, length)
            done = now.add(piece)
            if done is not None:
                yield now, done, False
    if now is not None:
        yield now, now.close(), True


def _id(uri: str | None) -> int | None:
    text = (uri or "").strip("<>").removeprefix("urn:x-page:")
    return int(text) if text.lstrip("-").isdigit() else None


def _damaged(data: bytes) -> tuple:
    return None, DAMAGED, None, None, len(data), None, data


def parse_record(data: bytes) -> tuple:
    """The columns of ``RECORD``. A response's digest and size are those of its payload as read; a damaged one's payload and size
    are those of the whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {name.strip().lower(): value.strip() for name, _, value in lines}
    kind, size = fields.get("warc-type", "").lower(), fields.get("content-length", "")
    if not kind or not (size.isascii() and size.isdigit()) or int(size) > len(rest):
        return _damaged(data)
    payload, http = rest[:int(size)], b""
    if kind in ("response", "revisit") or fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = payload.partition(b"\r\n\r\n")
    if kind == "revisit":
        sizes = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        digest, payload = fields.get("warc-payload-digest", "").removeprefix("sha1:"), None
        length = int(sizes[0]) if sizes and sizes[0].isdigit() else None
    else:
        digest, length = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
    return (_id(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), digest, length,
            _id(fields.get("warc-refers-to")), payload)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = [f.split()[0] for f in RECORD.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for _, packed, last in _ranges(batches):
        records, rest = _unpack(packed) if packed is not None else ([], b"")
        rows += map(parse_record, records)
        if rest and not last:  # what the end of a range cuts off may go on in the next
            rows.append(_damaged(rest))
        size += sum(map(len, records)) + len(rest)
        if len(rows) >= 500 or size > 8 << 20:
            yield _records(rows)
            rows, size = [], 0
    if rows:
        yield _records(rows)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut-off ends of ranges (seq -1, at the end of the range), leading parts of ranges (seq 0 and up) and, as seq -2, the
    starts of ranges that hold a member."""
    for now, packed, last in _ranges(batches):
        if not last:
            continue
        found = [(now.file, now.start, k, x) for k, x in enumerate(now.leading)]
        if now.parts is not None:
            found.append((now.file, now.start, -2, b""))
        if packed is not None and (rest := _unpack(packed)[1]):
            found.append((now.file, now.end, -1, rest))
        if found:
            yield pa.record_batch([pa.array(x) for x in zip(*found)], ["file", "at", "seq", "part"])


def _glue(parts: pd.DataFrame) -> pd.DataFrame:
    """The records of one file whose parts lie in several ranges: the cut-off end of one, the parts that lead the next
    ones, up to a range that holds a member. Ranges without a row lie inside a part."""
    rows: list[tuple] = []
    run: list[bytes] = []

    def close() -> None:
        records, rest = _unpack(b"".join(run))
        rows.extend(map(parse_record, records))
        if rest:
            rows.append(_damaged(rest))
        run.clear()

    # a cut-off end stands before what begins at the same place
    for seq, part in parts.assign(k=parts.seq.replace({-1: -3, -2: 1 << 40})).sort_values(["at", "k"])[
            ["seq", "part"]].itertuples(index=False):
        if seq < 0:
            close()
        if seq != -2:
            run.append(part)
    close()
    return pd.DataFrame(rows, columns=[f.split()[0] for f in RECORD.split(", ")])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records under ``path``: ``page_id``, ``record_type``, ``target_uri``, ``payload_digest``, ``payload_bytes``,
    ``refers_to`` and ``payload`` (null for a revisit). ``record_type`` is ``damaged`` for bytes that are no whole member or
    record; their number and the bytes are in ``payload_bytes`` and ``payload``."""
    small_batches(spark)
    pieces = (spark.read.options(**_RAW_GZ).option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
              .select(F.col("value").cast("binary").alias("piece"), "_metadata.file_path", "_metadata.file_block_start",
                      "_metadata.file_block_length"))
    cut = pieces.mapInArrow(_fragments, "file string, at bigint, seq bigint, part binary")
    return pieces.mapInArrow(_read, RECORD).unionByName(cut.groupBy("file").applyInPandas(_glue, RECORD))
