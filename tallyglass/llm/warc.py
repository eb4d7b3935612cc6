"""WARC archives: a deduplicating writer, and a reader that salvages what is left of damaged files.

Writer: every record is a gzip member of its own. Payloads that occur again are written as revisit records that name
the record with the smallest id; possible repeats are found by the Bloom filter of exact_dedup, so only those rows are
shuffled. Tasks write to files with names of their own and report them in a manifest; only the manifest of the
attempts that succeeded is committed, so a lost executor leaves an unlisted file and nothing else.

Reader: each member or record must pass its checks (gzip CRC, version line, headers, length, payload digest). After a
failure it searches for the next valid member or version line, goes on from there, and logs the bytes in between as a
quarantined gap. Files are read in blocks; only one record is held at a time.

Defined results: null payload counts as empty; a null id is written as an empty one and read back as null; rows that
repeat the smallest id of a payload are responses as well (a record can't refer to itself); a null url is left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_rows, open_shared, slices, stage_path, staged, utf8
from .exact_dedup import RepeatFilter

URN = "urn:tallyglass:record:"
EOL = b"\r\n"
BLOCK = 1 << 16
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP head, with the full payload's length, and no body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{record_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + EOL * 2 + block + EOL * 2


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(folder: str, most: int):
    def run(batches):
        out, size, count, path = None, 0, 0, ""
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for rid, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, size, count = open_shared(path, "w"), 0, 0
                member = _member(record_bytes(rid, url, utf8(payload), digest, refers))
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= most:
                    out.close()
                    done.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, count))
        paths, sizes, counts = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["path", "bytes", "records"])

    return run


def _digests(batches):
    for batch in slices(batches):
        payloads = [utf8(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(payload_digest, payloads), pa.string()), pa.array(map(len, payloads), pa.int64())], ["id", "sha", "size"])


def _digest(text: str | None) -> str:
    return payload_digest(utf8(text))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 0, archive_bytes: int = 32 << 20, max_filter_bits: int = 1 << 28) -> DataFrame:
    """Write the archives; return their manifest (path, bytes, records). Payloads under revisit_bytes never revisit."""
    few_rows(pages.sparkSession)
    plain = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), pages[payload_col].cast("string").alias("payload"))
    id_type = plain.schema["id"].dataType.simpleString()
    hashed = staged(plain.select("id", "payload").mapInArrow(_digests, f"id {id_type}, sha string, size long"), "payloads")
    bloom = RepeatFilter(hashed, hashed.count(), max_filter_bits)
    repeated = hashed.join(bloom.split_hashes()[1].select("sha").distinct(), "sha", "left_semi")
    first = repeated.filter(F.col("size") >= revisit_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = staged(first, "first")
    unique, perhaps = bloom.split_texts(plain, "payload", _digest, first)
    perhaps = perhaps.join(first, "sha", "left")
    refers = F.when(F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first"))
    columns = [F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "url", "payload", "sha"]
    rows = unique.select(*columns, F.lit(None).cast("string").alias("refers")).unionByName(perhaps.select(*columns, refers.cast("string").alias("refers")))
    return staged(rows.mapInArrow(_write(folder, archive_bytes), "path string, bytes long, records long"), "manifest")


class Damaged(Exception):
    """A member or record that fails its checks."""


class Archive:
    """One archive file, read by blocks."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def at(self, pos: int, n: int) -> bytes:
        self.file.seek(pos)
        return self.file.read(min(n, self.size - pos))

    def next_start(self, pos: int) -> int:
        """The next gzip magic or version line at or after pos, or the end."""
        while pos < self.size:
            data = self.at(pos, 1 << 20)
            if m := re.search(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n", data):
                return pos + m.start()
            if pos + len(data) >= self.size:
                break
            pos += max(1, len(data) - 9)
        return self.size

    def member(self, pos: int) -> tuple[bytes, int]:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            data = self.at(pos, BLOCK)
            if not data:
                raise Damaged("truncated member")
            try:
                parts.append(z.decompress(data))
            except zlib.error as e:
                raise Damaged(f"gzip: {e}") from None
            pos += len(data)
        return b"".join(parts), pos - len(z.unused_data)

    def plain(self, pos: int) -> tuple[bytes, int]:
        head = b""
        while (end := head.find(EOL * 2)) < 0:
            more = self.at(pos + len(head), BLOCK)
            if not more or len(head) > 1 << 20:
                raise Damaged("no end of headers")
            head += more
        m = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", head[:end], re.I)
        if not m:
            raise Damaged("no content length")
        total = end + 4 + int(m[1]) + 4
        if pos + total - 4 > self.size:
            raise Damaged("truncated record")
        return self.at(pos, total), min(pos + total, self.size)


VERSION = re.compile(rb"WARC/\d\.\d\r\n")


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The fields of the record at a place, and where it ends; raises Damaged if a check fails."""
    end = data.find(EOL * 2, at)
    if end < 0 or not VERSION.match(data, at):
        raise Damaged("no version line")
    head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)}
    if not head.get("content-length", "").isdigit() or "warc-type" not in head or "warc-record-id" not in head:
        raise Damaged("headers missing")
    n = int(head["content-length"])
    block = data[end + 4 : end + 4 + n]
    if len(block) < n:
        raise Damaged("truncated record")
    if (d := head.get("warc-block-digest")) and d.startswith("sha1:") and d[5:] != payload_digest(block):
        raise Damaged("block digest differs")
    payload, length, http = block, n, ""
    if head.get("content-type", "").startswith("application/http"):
        cut = block.find(EOL * 2)
        http, payload = block[:cut].decode("latin-1"), block[cut + 4 :]
        m = re.search(r"(?im)^content-length:[ \t]*(\d+)", http)
        length = int(m[1]) if m else len(payload)
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head["warc-type"] == "response":
        if digest and digest != payload_digest(payload):
            raise Damaged("payload digest differs")
        digest, length = digest or payload_digest(payload), len(payload)
    name = lambda k: head[k].strip("<>").removeprefix(URN) if k in head else None
    return {"type": head["warc-type"], "id": name("warc-record-id"), "refers_to": name("warc-refers-to"), "url": head.get("warc-target-uri"), "payload": payload, "digest": digest, "length": length}, end + 4 + n


def parse_records(data: bytes):
    """Yield ("record", fields) and ("gap", reason) of the records of a member, one after the other.

    After a damaged record it goes on at the next version line; a gap names its bytes in the unpacked member.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        if gap is None and data[at : at + 2] == EOL:
            at += 2
            continue
        try:
            fields, end = parse_record(data, at)
        except Damaged as e:
            gap, why = (at, str(e)) if gap is None else (gap, why)
            m = VERSION.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap is not None:
            yield "gap", f"{why} (bytes {gap} to {at} of the member)"
            gap = None
        yield "record", fields
        at = end
    if gap is not None:
        yield "gap", f"{why} (bytes {gap} to {len(data)} of the member)"


def salvage(file):
    """Yield ("record", start, end, fields) and ("gap", start, end, reason), in file order."""
    archive = Archive(file)
    pos, gap, why = 0, None, ""
    while pos < archive.size:
        lead = archive.at(pos, 4)
        if gap is None and lead[:2] == EOL:
            pos += 2
            continue
        try:
            if lead[:3] == MAGIC:
                data, end = archive.member(pos)
            elif lead == b"WARC":
                data, end = archive.plain(pos)
            else:
                raise Damaged("no member or version line")
            found = list(parse_records(data))
            if not any(kind == "record" for kind, _ in found):
                parse_record(data)
                raise Damaged("no record")
        except Damaged as e:
            gap, why = (pos, str(e)) if gap is None else (gap, why)
            pos = archive.next_start(pos + 1)
            continue
        if gap is not None:
            yield "gap", gap, pos, why
            gap = None
        for kind, x in found:
            yield kind, pos, end, x
        pos = end
    if gap is not None:
        yield "gap", gap, archive.size, why


RECORDS = "path string, kind string, start long, end long, reason string, record_type string, record_id string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary"


def _read(payloads: bool, rows: int = 200):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in RECORDS.split(", ")]

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_shared(path, "r") as file:
                    for kind, start, end, x in salvage(file):
                        if kind == "gap":
                            held.append((path, kind, start, end, x, *[None] * 7))
                        else:
                            body = x["payload"] if payloads else None
                            held.append((path, kind, start, end, None, x["type"], x["id"], x["refers_to"], x["url"], x["digest"], x["length"], body))
                            size += len(body or b"")
                        if len(held) >= rows or size > 16 << 20:
                            yield out(held)
                            held, size = [], 0
        if held:
            yield out(held)

    return run


def read_archives(files: DataFrame, payloads: bool = True, task_bytes: int = 64 << 20) -> DataFrame:
    """Records and quarantined gaps of the archives in column `path`.

    Whole archives go to tasks by their number, in as many tasks as their `bytes` ask for (a task each without that
    column); the number of partitions is given, so that small paths are not gathered into one task.
    """
    size = F.sum("bytes") if "bytes" in files.columns else F.lit(0)
    total = files.agg(size.alias("bytes"), F.count(F.lit(1)).alias("files")).first()
    tasks = min(total.files, max(files.sparkSession.sparkContext.defaultParallelism, -(-(total.bytes or 0) // task_bytes))) if total.bytes else total.files
    spread = files.select("path").repartitionByRange(max(1, tasks), "path")
    return spread.mapInArrow(_read(payloads), RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = read_archives(write_archives(pages, stage_path(spark, "archives")), payloads=False).filter("kind = 'record'")
    kind = pages.schema["page_id"].dataType
    return records.select(
        F.expr(f"try_cast(record_id as {kind.simpleString()})").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
