"""WARC archives: a writer and a sequential reader.

Archives are gzip files with one member per record, so each record can be
inflated by itself; the reader walks through a file member by member with
incremental inflation, frames blocks by their Content-Length and checks
digests. Files are opened through Arrow's file systems, wherever the shared
folder is."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import written
from tidewatch.session import shared_dir

#: Payloads below this are never revisits.
LEAST_REVISIT = 100
#: A writer starts the next file after this many compressed bytes.
ROLL_BYTES = 64 << 20
READ_BYTES = 1 << 20
#: Archives are dealt over so many tasks at most; a task reads one after the other.
MAX_READ_TASKS = 50_000
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


class WarcError(ValueError):
    """A record that cannot be framed, inflated or verified."""


def _sha(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _head(fields: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit keeps the HTTP header (with the payload's length) only."""
    http = b"HTTP/1.1 200 OK\r\n" + _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if " " < c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_ID}{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", _sha(block)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _head(fields) + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def records(stream, size: int = READ_BYTES) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a gzip stream, one member at a
    time; memory for one record and one read."""
    pending, ended = b"", False
    while True:
        if not pending and not ended:
            pending = stream.read(size)
            ended = not pending
        if not pending:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not pending:
                pending = stream.read(size)
                if not pending:
                    raise WarcError("the archive ends inside a record")
            try:
                parts.append(inflate.decompress(pending))
            except zlib.error as e:
                raise WarcError(f"damaged member: {e}") from e
            pending = inflate.unused_data if inflate.eof else b""
        yield parse(b"".join(parts))


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/1."):
        raise WarcError("no record header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError("a header line without a name")
        fields[name.decode().strip().lower()] = value.decode("utf-8", "surrogatepass").strip()
    length = int(fields.get("content-length", -1))
    if length < 0 or rest[length:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not frame the block")
    block = rest[:length]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != _sha(block):
        raise WarcError("block digest differs")
    return fields, block


def page(fields: dict[str, str], block: bytes) -> dict:
    """The row a record stands for. A response's payload is checked against its digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")[1:]) if k.lower() == b"content-length"), None)
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (length != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise WarcError("payload digest or length differs")
    number = lambda name: (lambda v: int(v) if v else None)(fields.get(name, "").strip("<>").removeprefix(_ID))
    return {"page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number("warc-refers-to"),
            "payload_bytes": length, "payload_digest": digest, "payload": payload if kind == "response" else None}


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, revisit, refers_to: of equal payloads of at
    least 100 bytes the smallest page_id is the response. Rows that share that
    id are all responses; a null page_id is a response too."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= LEAST_REVISIT
    firsts = rows.filter(long & F.col("page_id").isNotNull()).groupBy(F.col("digest").alias("key")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    key = F.when(long & F.col("page_id").isNotNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.col("digest"))))
    joined = rows.withColumn("key", key).join(firsts, "key", "left")
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.lit(False))
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, level: int = 6, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the pages below ``folder``; returns the manifest (path, records).

    Every attempt of a task writes files of its own names and only a finished
    task's files get into the manifest, so a lost executor leaves stray files
    but no wrong record."""
    root = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(root)
        fs.create_dir(at, recursive=True)
        out, name, count, size, done = None, "", 0, 0, []
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for r in batch.slice(i, 64).to_pylist():
                    if out is None:
                        name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    packed = member(record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["revisit"]), level)
                    out.write(packed)
                    count, size = count + 1, size + len(packed)
                    if size >= roll_bytes:
                        out.close()
                        out = done.append((f"{root}/{name}", count))
        if out is not None:
            out.close()
            done.append((f"{root}/{name}", count))
        if done:
            paths, counts = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return written(planned(pages).mapInArrow(write, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the files in ``manifest``; a damaged, short or
    altered file fails the read. Files are dealt over the tasks one by one."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                fs, at = _open(path)
                rows, seen, held = [], 0, 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for fields, block in records(stream):
                        rows.append(page(fields, block))
                        seen, held = seen + 1, held + len(block)
                        if len(rows) >= 256 or held >= 8 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)
                if seen != expected:
                    raise WarcError(f"{path}: {seen} records instead of {expected}")

    tasks = max(1, min(MAX_READ_TASKS, manifest.count()))  # a number, else small manifests would be read by one task
    return manifest.repartition(tasks, "path").mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    manifest = write_archives(pages, shared_dir(pages.sparkSession, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
