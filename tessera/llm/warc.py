"""WARC archives: one gzip member a record, written by tasks to shared storage and read back as a stream."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import delete, flat, scratch_path, settle  # noqa: F401

#: Compressed bytes read at a time, and at which a writer starts its next archive.
READ, ROTATE = 1 << 16, 64 << 20


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def record(kind: str, uri: str, page_id: str, payload: bytes, digest: str, refers_to: str = "", size: int | None = None) -> bytes:
    """One record as one gzip member. A revisit has no block; it names the page it refers to and the full payload's length."""
    block = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {''.join(uri.split())}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Page-ID: {page_id}"]
    if kind == "response":
        lines.append(f"WARC-Block-Digest: sha1:{digest}")
    else:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}", f"WARC-Payload-Length: {len(payload) if size is None else size}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(head) + press.compress(block) + press.compress(b"\r\n\r\n") + press.flush()


def members(stream, size: int = READ) -> Iterator[bytes]:
    """The contents of each gzip member, decompressed piece by piece; an archive cut short is an error."""
    rest = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            rest = rest or stream.read(size)
            if not rest:
                if parts or unpack.unconsumed_tail:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; framing and digest are checked."""
    head, sep, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(headers["Content-Length"])
    block, end = rest[:n], rest[n:]
    if len(block) != n or end != b"\r\n\r\n":
        raise ValueError("the content length does not frame the record")
    if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
        raise ValueError(f"digest mismatch in {headers.get('WARC-Record-ID')}")
    return headers, block


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each attempt writes under a name of its own; only the names that a finished task returns are read."""
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        out, name, done, n = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.record_batch([pa.array([name]), pa.array([n], pa.int64()), pa.array([done], pa.int64())], names=["archive", "records", "bytes"])

        for batch in batches:
            ids, urls, refs = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
            buf, off = flat(batch.column("html"))
            raw = buf.tobytes()
            for i, (id_, url, ref) in enumerate(zip(ids, urls, refs, strict=True)):
                if out is None:
                    name, done, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{at}/{name.rpartition('/')[2]}", compression=None)
                payload = raw[off[i] : off[i + 1]]
                member = record("response" if ref is None else "revisit", url or "", "" if id_ is None else str(id_), payload, digest32(payload), "" if ref is None else str(ref))
                out.write(member)
                done, n = done + len(member), n + 1
                if done >= ROTATE:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return write


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("archive").to_pylist():
            store, at = fs.FileSystem.from_uri(uri)
            rows: list[tuple] = []
            with store.open_input_stream(at, compression=None) as stream:
                for member in members(stream):
                    head, block = parse(member)
                    revisit = head["WARC-Type"] == "revisit"
                    rows.append((int(head["WARC-Page-ID"]) if head["WARC-Page-ID"] else None, head["WARC-Target-URI"], int(head["WARC-Payload-Length"]) if revisit else len(block), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], int(head["WARC-Refers-To-Page"]) if revisit else None))
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
            yield _rows(rows)


NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES)], names=NAMES)


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(archive, records, bytes) of the archives written to a folder that executors share: a record for each page, its payload the html
    in UTF-8 (null: empty). Of pages with equal payloads that with the largest page_id is the response, all others are
    revisits that refer to it; a null page_id never is the response of pages that have one, and pages of equal payload and equal largest
    id are responses alike. A null url is empty; the contents of revisits are not written; a very long page is one record. No pages give no
    archives; extra columns are ignored."""
    pages = pages.select("page_id", "url", "html")
    key = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    keep = pages.select(key.alias("key"), "page_id").groupBy("key").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1").select("key", "largest")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("largest")), F.lit(None)).otherwise(F.col("largest"))
    slated = pages.withColumn("key", key).join(keep, "key", "left").select("page_id", "url", "html", refers.cast("long").alias("refers_to"))
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return settle(slated.mapInArrow(_write(folder), "archive string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record, as streamed from its archive: content length
    and block digest are verified, a bad record ends the job with an error. Archives are read piece by piece, a record at a time in memory; null and
    repeated ids are records of their own; no archives give no rows."""
    n = max(1, min(archives.count(), 10 * int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return archives.select("archive").repartition(n).mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
