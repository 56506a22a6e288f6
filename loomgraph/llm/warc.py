"""WARC archives: writer, monolithic-gzip normaliser with a sidecar offset index, and reader.

A WARC file that was gzipped as a whole can't be read at an offset. The normaliser inflates such a
stream once, in pieces, rewrites every record as a gzip member of its own and writes a sidecar index
of JSON lines (record id, type, target, offset, length). One task handles a file, in bounded memory
however long the file or a record is. File names hold a random part, and the list of files is a
table written by the attempts that succeeded, so a lost executor leaves orphans, never wrong data.

Payloads repeat as revisit records: payloads are equal when their SHA-256 are (the SHA-1 is only the
record's digest); those that occur more than once are a table of their own, and only digests are shuffled to
find them. A payload of very many pages is dealt to several tasks.

Defined results: a null payload is empty; a null url is left out; rows without an id never win while
a row with an id has the same payload; rows that repeat the winning id are responses as well; a payload of any
length is taken whole (one must fit in a task); an empty table makes no file and an empty result; further
columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.files import create, open_file, open_stream
from loomgraph.llm.skew import join_counted
from loomgraph.session import materialise, table, work_dir

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PIECE = 1 << 18


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record: the HTTP response, or for a revisit its header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#%!*~()[]')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, pack = None, "", 0, None
        for batch in batches:
            for page_id, url, html, keep_id, dup in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "keep_id", "dup")), strict=True):
                if out is None:
                    path = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
                    out, pack = create(path), zlib.compressobj(level, zlib.DEFLATED, 31)
                revisit = bool(dup) and keep_id is not None and page_id != keep_id
                out.write(pack.compress(record(page_id, url, html.encode(), keep_id, revisit, date)))
                n += 1
        if out is not None:
            out.write(pack.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    return run


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write pages (page_id, url, html) as monolithic .warc.gz files, one for each partition.

    Returns the table of (path, records).
    """
    html = F.coalesce("html", F.lit(""))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.unhex(F.sha2(html, 256)).alias("sha"), F.monotonically_increasing_id().alias("uid"))
    twice = materialise(src.groupBy("sha").agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "payloads")
    marked = join_counted(src, twice, ["sha"], ["uid"], "n", "left").select("page_id", "url", "html", "keep_id", F.col("n").isNotNull().alias("dup"))
    return materialise(marked.mapInArrow(_writer(folder, date, level), "path string, records long"), "archives")


class _Inflated:
    """Bytes of a gzip stream of one or more members, read once in pieces."""

    def __init__(self, stream) -> None:
        self.stream, self.buf, self.z, self.done = stream, bytearray(), zlib.decompressobj(31), False

    def more(self) -> bool:
        while not self.done:
            data = self.z.unconsumed_tail or self.stream.read(_PIECE)
            if not data:
                self.done = True
                return False
            got = self.z.decompress(data, 4 * _PIECE)
            while self.z.eof:
                rest = self.z.unused_data or self.stream.read(_PIECE)
                if not rest:
                    self.done = True
                    break
                self.z = zlib.decompressobj(31)
                got += self.z.decompress(rest, 4 * _PIECE)
            if got:
                self.buf += got
                return True
        return False

    def head(self) -> bytes | None:
        """The next header, or None at the end; empty lines before it are skipped."""
        while True:
            start = len(self.buf) - len(self.buf.lstrip(b"\r\n"))
            if start:
                del self.buf[:start]
            end = self.buf.find(b"\r\n\r\n")
            if end >= 0:
                out = bytes(self.buf[: end + 4])
                del self.buf[: end + 4]
                return out
            if not self.more():
                if self.buf:
                    raise ValueError("the stream ends inside a header")
                return None

    def block(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buf and not self.more():
                raise ValueError("the stream ends inside a record")
            piece = bytes(self.buf[:n])
            del self.buf[:n]
            n -= len(piece)
            yield piece


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def normalise_file(path: str, out_path: str, level: int = 1) -> int:
    """Rewrite one file with a gzip member per record and the index beside it; the record count."""
    n = at = 0
    with open_stream(path) as raw, create(out_path) as out, create(out_path + ".idx") as index:
        src = _Inflated(raw)
        while (head := src.head()) is not None:
            named = fields(head)
            pack, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
            for piece in chain([head], src.block(int(named["content-length"])), [b"\r\n\r\n"]):
                size += out.write(pack.compress(piece))
            size += out.write(pack.flush())
            entry = {"id": named.get("warc-record-id"), "type": named.get("warc-type"), "uri": named.get("warc-target-uri"), "offset": at, "length": size}
            index.write(json.dumps(entry).encode() + b"\n")
            at, n = at + size, n + 1
    return n


def _normaliser(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out = f"{path.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.members.warc.gz"
                n = normalise_file(path, out, level)
                yield pa.RecordBatch.from_pydict({"path": [out], "records": pa.array([n], pa.int64())})

    return run


def _spread(archives: DataFrame) -> DataFrame:
    """About one file for each task."""
    return archives.repartition(max(1, archives.count()), "path")


def normalise(archives: DataFrame, level: int = 1) -> DataFrame:
    """(path, records) of the rewritten files; each has an index at path + '.idx'."""
    return materialise(_spread(archives).select("path").mapInArrow(_normaliser(level), "path string, records long"), "members")


_READ = "record_id string, record_type string, target string, refers_to string, payload_digest string, payload binary, payload_bytes long, offset long"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    types = [pa.string()] * 5 + [pa.binary(), pa.int64(), pa.int64()]

    def send(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows, held = [], 0
            with open_file(path) as data, open_stream(path + ".idx") as lines:
                rest = b""
                while piece := lines.read(_PIECE):
                    *whole, rest = (rest + piece).split(b"\n")
                    for entry in map(json.loads, whole):
                        data.seek(entry["offset"])
                        member = zlib.decompress(data.read(entry["length"]), 31)
                        end = member.index(b"\r\n\r\n") + 4
                        named = fields(member[:end])
                        block = member[end : end + int(named["content-length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(fields(http)["content-length"])
                        told = named["warc-payload-digest"].removeprefix("sha1:")
                        if named["warc-type"] == "response" and (len(payload) != size or digest(payload) != told):
                            raise ValueError(f"{path}: payload of {entry['id']} does not match its header")
                        rows.append((named["warc-record-id"], named["warc-type"], named.get("warc-target-uri"), named.get("warc-refers-to"), told, payload, size, entry["offset"]))
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield send(rows)
                            rows, held = [], 0
            if rows:
                yield send(rows)


def read_archives(members: DataFrame) -> DataFrame:
    """The records of normalised files, each read by itself at its offset in the index."""
    return _spread(members).select("path").mapInArrow(_reader, _READ)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    whole = write_archives(table(spark, sf_dir, "pages"), folder)
    members = normalise(whole)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return read_archives(members).select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


QUERIES = {"op4_warc": op4_warc}
ORACLE: dict[str, str] = {}
