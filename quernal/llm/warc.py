"""WARC archives: writing, a normaliser for monolithic gzip, and indexed reading.

`write_monolithic` writes pages as archives that are one gzip stream each.
`normalise` inflates such a stream once, from front to back, rewrites every
record as a gzip member of its own, and writes a sidecar index with each
record's offset and length.  `read_indexed` opens the rewritten archives by
that index.  Archives are real files in the cluster's shared folder, written
under a temporary name and then renamed; only those whose task has finished
are listed and read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, keep, shared_dir, slices, text_buffers

MIN_REVISIT = 1000
ARCHIVE_BYTES = 16 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long, record_length long"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, parts) -> None:
    """Write chunks under a temporary name, then rename: readers see all or nothing."""
    store, path = _open(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temp, compression=None) as f:
        for part in parts:
            f.write(part)
    store.move(temp, path)


def get_file(uri: str) -> bytes:
    store, path = _open(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\n"]
    head += [f"{k}: {v}\r\n" for k, v in headers.items()]
    return "".join(head).encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    headers = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {safe}')}>", "WARC-Target-URI": safe, "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(len(payload))}
    if page_id is not None:
        headers["X-Page-ID"] = str(page_id)
    if refers_to is None:
        return record("response", headers | {"Content-Type": "application/http; msgtype=response"}, HTTP_HEAD + payload)
    return record("revisit", headers | {"WARC-Profile": PROFILE, "X-Refers-To-Page": str(refers_to), "Content-Type": "application/http; msgtype=response"}, HTTP_HEAD)


def parse(raw: bytes | memoryview) -> tuple[str, dict[str, str], bytes]:
    """Type, headers and block of one record."""
    raw = bytes(raw)
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode("utf-8").split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = raw[end + 4 : end + 4 + int(headers["Content-Length"])]
    return headers["WARC-Type"], headers, block


def stream_records(chunks):
    """Records of one uncompressed byte stream, each yielded once complete."""
    buffer = bytearray()
    need = None
    for chunk in chunks:
        buffer += chunk
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                size = re.search(rb"(?i)\r\nContent-Length: *(\d+)", bytes(buffer[:end]))
                if size is None:
                    raise ValueError("record without Content-Length")
                need = end + 4 + int(size[1]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer.strip():
        raise ValueError("truncated record at the end of the stream")


def inflate(raw: bytes, step: int = 1 << 20):
    """Bytes of a gzip file, whether it has one member or many, in bounded pieces."""
    at = 0
    while at < len(raw):
        z = zlib.decompressobj(31)
        while not z.eof:
            piece = z.unconsumed_tail
            if not piece:
                piece = raw[at : at + step]
                at += len(piece)
            out = z.decompress(piece, 4 * step)
            if not piece and not out and not z.eof:
                raise ValueError("truncated gzip stream")
            yield out
        at -= len(z.unused_data)


def normalise_bytes(raw: bytes) -> tuple[bytes, list[dict]]:
    """The archive with one gzip member a record, and its offset index."""
    out, index = bytearray(), []
    for rec in stream_records(inflate(raw)):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(rec) + z.flush()
        kind, headers, _ = parse(rec)
        index.append({"offset": len(out), "length": len(member), "type": kind, "id": headers.get("WARC-Record-ID", "")})
        out += member
    return bytes(out), index


def assign_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and, for revisits, the page referred to.

    The winner of a digest is found on map-side combined rows; the join back is
    a sort-merge join, whose large keys adaptive execution splits.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    winners = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= MIN_REVISIT)
    winners = winners.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and winner is not null")
    joined = rows.join(winners.hint("merge"), "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("winner")), F.col("winner"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_monolithic(typed: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives of one gzip stream each; returns their paths and record counts.

    Every attempt of a task names its archives anew, so what a lost one left
    behind is in no row of the result and is not read.
    """

    def run(batches):
        from pyspark import TaskContext

        part, seq, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex[:12]
        z, parts, size, n = None, [], 0, 0

        def done():
            nonlocal seq, z, parts, size, n
            parts.append(z.flush())
            path = f"{folder}/part-{part:06d}-{seq:05d}-{attempt}.warc.gz"
            put_file(path, parts)
            batch = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["archive", "records"])
            seq, z, parts, size, n = seq + 1, None, [], 0, 0
            return batch

        for batch in slices(batches, "html"):
            data, off = text_buffers(col(batch, "html"))
            whole = data.tobytes()
            for i, (page, url, digest, refers) in enumerate(zip(*(col(batch, c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")), strict=True)):
                z = z or zlib.compressobj(6, zlib.DEFLATED, 31)
                rec = page_record(page, url, whole[off[i] : off[i + 1]], digest, refers)
                parts.append(z.compress(rec))
                size, n = size + len(rec), n + 1
                if size >= archive_bytes:
                    yield done()
        if n:
            yield done()

    return typed.mapInArrow(run, "archive string, records long")


def normalise(spark, source: str, target: str, written: DataFrame | None = None) -> DataFrame:
    """Rewrite every archive below `source` (of them those that `written` lists); returns the new paths."""

    def run(batches):
        for batch in batches:
            paths = []
            for path, raw in zip(col(batch, "path").to_pylist(), col(batch, "content"), strict=True):
                body, index = normalise_bytes(raw.as_py())
                out = f"{target}/{path.rsplit('/', 1)[1]}"
                put_file(out, [body])
                put_file(out + ".idx", ["".join(json.dumps(x) + "\n" for x in index).encode()])
                paths.append((out, len(index)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in paths], pa.string()), pa.array([n for _, n in paths], pa.int64())], names=["archive", "records"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(source)
    if written is not None:
        name = F.element_at(F.split("path", "/"), -1)
        files = files.withColumn("name", name).join(written.select(F.element_at(F.split("archive", "/"), -1).alias("name")), "name", "left_semi")
    return files.select("path", "content").mapInArrow(run, "archive string, records long")


def read_indexed(spark, folder: str) -> DataFrame:
    """One row per record, opened member by member through the sidecar indexes."""

    def run(batches):
        for batch in batches:
            for path, raw in zip(col(batch, "path").to_pylist(), col(batch, "content"), strict=True):
                raw, rows = raw.as_py(), []
                for x in map(json.loads, get_file(path + ".idx").decode().splitlines()):
                    kind, headers, block = parse(zlib.decompress(raw[x["offset"] : x["offset"] + x["length"]], 31))
                    page = int(headers["X-Page-ID"]) if "X-Page-ID" in headers else None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, digest, refers = len(payload), hashlib.sha1(payload).hexdigest(), None
                        if digest != headers["WARC-Payload-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"digest mismatch in {path} at {x['offset']}")
                    else:
                        size, digest, refers = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Refers-To-Page"])
                    rows.append((page, size, digest, kind, refers, path, x["offset"], x["length"]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                cols = list(zip(*rows, strict=True)) or [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("path", "content").mapInArrow(run, ROW)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back archives of all pages.

    Null html is an empty payload, null url an empty target; a row with null
    page_id revisits the winner of its payload and else is a response; of rows
    that repeat the winning page_id all are responses; an empty table gives no
    rows; other columns are ignored.
    """
    spark = pages.sparkSession
    raw, out = shared_dir(spark, "warc-raw"), shared_dir(spark, "warc")
    written = keep(write_monolithic(assign_types(pages), raw), "warc-list")  # a row an archive
    if written.isEmpty():
        return spark.createDataFrame([], ROW)
    normalise(spark, raw, out, written).agg(F.sum("records")).first()
    return read_indexed(spark, out)
