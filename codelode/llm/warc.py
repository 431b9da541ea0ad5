"""WARC archives: a writer with revisit records, and a salvage reader.

Every record is a gzip member of its own. The reader checks each member (gzip checksum), record (version line, headers,
content length, end mark) and payload (digest). Where a check fails it searches on for the next gzip member that begins
a record, or in plain files for the next version line, goes on there, and logs the bytes between as a gap.

Of records with equal payloads of at least min_bytes, the one with the smallest page_id is a response and the others are
revisit records without payload; smaller payloads are always responses.

Defined results: null html is an empty payload; a null url is written as an empty target; rows with a null page_id are
revisits of an equal payload that has an id, else responses; rows that repeat a page_id and its payload are alike; an
empty table writes no archive and reads no record; payloads of any length are written whole; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialized, staging_path, stored, table

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 16
HOT = 1000
_MANIFEST = "path string, bytes bigint, records bigint"
RECORDS = (
    "path string, start bigint, end bigint, gap string, page_id bigint, url string, record_type string, refers_to bigint, "
    "payload binary, payload_bytes bigint, payload_digest string"
)


@dataclass(frozen=True)
class WarcParams:
    min_bytes: int = 0
    date: str = "2024-01-01T00:00:00Z"
    #: A task begins another archive after so many bytes.
    archive_bytes: int = 64 << 20
    level: int = 4
    #: Repeated payloads (digest and id each) up to which they are broadcast.
    broadcast_rows: int = 500_000
    #: Bytes of archives that a reading task takes, where there are more than the cluster has cores.
    read_bytes: int = 256 << 20


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str) -> bytes:
    """An uncompressed record; first is the page that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or ""),
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        f"WARC-Block-Digest: sha1:{_digest(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(first)}", f"X-Refers-To-Page-Id: {first}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def parse_record(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record at data[at:] and where it ends, or why it is none."""
    version = _VERSION.match(data, at)
    if not version:
        return "no version line"
    stop = data.find(b"\r\n\r\n", version.end())
    if stop < 0:
        return "headers do not end"
    head = {}
    for line in data[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        head[name.strip().lower()] = value.strip()
    if not head.get(b"content-length", b"").isdigit():
        return "no content length"
    begin, size = stop + 4, int(head[b"content-length"])
    block = data[begin : begin + size]
    if len(block) < size or data[begin + size : begin + size + 4] != b"\r\n\r\n":
        return "content length does not fit"
    wanted = head.get(b"warc-block-digest", b"").removeprefix(b"sha1:").decode()
    if wanted and wanted != _digest(block):
        return "block digest differs"
    end = begin + size + 4
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = head.get(b"warc-type", b"").decode()
    told = head.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode()
    if kind == "revisit":
        length = re.search(rb"(?i)content-length:\s*(\d+)", http)
        size, digest = int(length.group(1)) if length else None, told
    else:
        size, digest = len(payload), _digest(payload)
        if told and told != digest:
            return "payload digest differs"
    number = lambda k: int(head[k]) if head.get(k, b"").lstrip(b"-").isdigit() else None
    return {
        "page_id": number(b"x-page-id"), "url": head.get(b"warc-target-uri", b"").decode("utf-8", "replace"), "record_type": kind,
        "refers_to": number(b"x-refers-to-page-id"), "payload": None if kind == "revisit" else payload, "payload_bytes": size, "payload_digest": digest,
    }, end


class SalvageReader:
    """Yields records and gaps of one archive; f is a seekable file of size bytes. Holds one record at a time."""

    def __init__(self, f, size: int):
        self.f, self.size = f, size

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(min(n, self.size - at)) if at < self.size else b""

    def _member(self, at: int) -> tuple[bytes, int] | str:
        """Content of the gzip member at a place and where it ends."""
        unpack, parts, pos = zlib.decompressobj(31), [], at
        while not unpack.eof:
            raw = self._read(pos, _READ)
            if not raw:
                return "member does not end"
            try:
                parts.append(unpack.decompress(raw))
            except zlib.error as e:
                return f"bad member: {e}"
            pos += len(raw)
        return b"".join(parts), pos - len(unpack.unused_data)

    def _next(self, at: int, compressed: bool) -> int:
        """The next place from at on where a member that begins a record, or a plain record's version line, stands."""
        mark, carry = (_MAGIC if compressed else b"WARC/1."), 16
        while at < self.size:
            raw = self._read(at, 1 << 20)
            i = raw.find(mark)
            while i >= 0:
                if not compressed:
                    if len(raw) - i >= 10 or at + len(raw) >= self.size:
                        if _VERSION.match(raw, i):
                            return at + i
                else:
                    try:
                        if zlib.decompressobj(31).decompress(self._read(at + i, _READ), 16)[:5] == b"WARC/":
                            return at + i
                    except zlib.error:
                        pass
                i = raw.find(mark, i + 1)
            if at + len(raw) >= self.size:
                break
            at += len(raw) - carry
        return self.size

    def _plain(self, at: int) -> tuple[dict, int] | str:
        n = 1 << 16
        while True:
            data = self._read(at, n)
            got = parse_record(data, 0)
            # a record longer than what was read looks cut; read on until it fits or the file ends
            if isinstance(got, str) and got in ("headers do not end", "content length does not fit") and len(data) == n and n < self.size - at:
                stop = data.find(b"\r\n\r\n")
                length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\r\n", data[: stop + 2]) if stop >= 0 else None
                n = stop + 8 + int(length.group(1)) if length and n < stop + 8 + int(length.group(1)) <= self.size - at else min(2 * n, self.size - at) if not length else 0
                if n:
                    continue
            return (got[0], at + got[1]) if not isinstance(got, str) else got

    def items(self) -> Iterator[dict]:
        at, gap, why = 0, None, ""
        while at < self.size:
            compressed = self._read(at, 3) == _MAGIC
            found: list[dict] | str
            if compressed:
                got = self._member(at)
                found, end = (got, at) if isinstance(got, str) else ([], got[1])
                inner = 0
                while not isinstance(found, str) and inner < len(got[0]):
                    one = parse_record(got[0], inner)
                    if isinstance(one, str):
                        # what was read of this member so far stands; the rest is quarantined from the next version line on
                        nxt = _VERSION.search(got[0], inner + 1)
                        found.append({"gap": one})
                        if not nxt:
                            break
                        inner = nxt.start()
                    else:
                        found.append(one[0])
                        inner = one[1]
            else:
                got = self._plain(at)
                found, end = (got, at) if isinstance(got, str) else ([got[0]], got[1])
            if isinstance(found, str):
                gap, why = (at, found) if gap is None else (gap, why)
                plain_next = self._next(at + 1, False) if not compressed else self.size
                at = min(self._next(at + 1, True), plain_next)
                continue
            if gap is not None:
                yield {"start": gap, "end": at, "gap": why}
                gap = None
            for one in found:
                yield {"start": at, "end": end, **one}
            at = end
        if gap is not None:
            yield {"start": gap, "end": self.size, "gap": why}


def _with_first(rows: DataFrame, repeated: DataFrame, params: WarcParams) -> DataFrame:
    """rows with first: the page whose payload theirs repeats, or null. Pages of a payload that many repeat stay where they are."""
    if repeated.limit(params.broadcast_rows + 1).count() <= params.broadcast_rows:
        return rows.join(F.broadcast(repeated.drop("n")), "sha", "left")
    total = repeated.agg(F.sum("n")).first()[0]
    # at most HOT payloads hold more than one in HOT of the repeated pages
    often = F.col("n") * HOT > total
    hot = F.broadcast(repeated.filter(often).drop("n"))
    rest = rows.join(hot.select("sha"), "sha", "left_anti").join(repeated.filter(~often).drop("n"), "sha", "left")
    return rows.join(hot, "sha").unionByName(rest)


def write_archives(pages: DataFrame, folder: str, params: WarcParams = WarcParams()) -> DataFrame:
    """Writes pages (page_id, url, html) and returns the manifest: path, bytes and records of each finished archive.

    Archive names hold the task attempt, and the manifest only names those of attempts that succeeded, so a repeated task
    leaves no record twice.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    equal = rows.filter(F.octet_length("html") >= params.min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = materialized(equal.filter("n > 1").select("sha", "first", "n"))
    judged = _with_first(rows, repeated, params)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= params.min_bytes)
    judged = judged.select("page_id", "url", "html", "first", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context, n, out, path, size, records, done = TaskContext.get(), 0, None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, first, again in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first", "revisit"))):
                if out is None:
                    path = f"{root}/{context.partitionId():06d}-{context.taskAttemptId()}-{n}.warc.gz"
                    out, size, records, n = store.open_output_stream(path, compression=None), 0, 0, n + 1
                data = member(record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), first, again, params.date), params.level)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= params.archive_bytes:
                    out.close()
                    done.append((path, size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return materialized(judged.mapInArrow(run, _MANIFEST))


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True, params: WarcParams = WarcParams()) -> DataFrame:
    """Records and gaps of the archives (path, bytes); gap says why bytes are quarantined and is null for records.

    Archives are dealt out in turn, several to a task: they are of much the same size, so tasks are too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                with store.open_input_file(path) as f:
                    for item in SalvageReader(f, f.size()).items():
                        held.append({**item, "path": path, "payload": item.get("payload") if with_payload else None})
                        size += len(held[-1]["payload"] or b"") + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    archives, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(-(-size // params.read_bytes), manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("path").repartition(max(1, min(archives, tasks))).mapInArrow(run, RECORDS)


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = staging_path(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    found = stored(read_archives(manifest, folder, with_payload=False).drop("payload"), "records")
    # archives just written have no gaps, and give back as many records as were put in
    wanted = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    records, gaps = found.agg(F.count_if(F.isnull("gap")), F.count("gap")).first()
    if records != wanted or gaps:
        raise RuntimeError(f"{records} of {wanted} records read back, {gaps} gaps")
    return found.filter("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = "list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('" + _LETTERS + "', ((('0x' || substr(sha, (5 * i + 1)::INT, 5))::INT >> s) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '')"
OP5_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, strlen(body) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""
