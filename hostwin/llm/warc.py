"""WARC archives: one gzip member per record, written and read record by record.

``write_archives`` stores one response per distinct payload and a revisit record for each further
copy; ``read_archives`` streams archives through incremental decompression, frames every record
by its Content-Length and verifies its digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostwin.llm.common import Batches, slices

VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD_SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, "
                 "payload_bytes bigint, payload_digest string, payload binary")
CHUNK = 1 << 16


def base32_sha1(data: bytes) -> str:
    """The digest as WARC headers carry it: upper-case base32, without a label."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a URI; all executors must reach it."""
    scheme, colon, rest = path.partition(":")
    if not colon:
        return arrow_fs.LocalFileSystem(), path
    # Hadoop's names for the same stores.
    return arrow_fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest)


def _header(lines: dict[str, str | None]) -> bytes:
    shown = [f"{k}: {_one_line(v)}" for k, v in lines.items() if v is not None]
    return "\r\n".join([VERSION, *shown, "", ""]).encode()


def _one_line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None,
                  date: str) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit, which leaves the payload out."""
    head = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head if refers_to is not None else head + payload
    header = _header({
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": uri,
        "WARC-Profile": None if refers_to is None else REVISIT_PROFILE,
        "WARC-Refers-To": None if refers_to is None else f"<{refers_to}>",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))})
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(header) + gz.compress(block) + gz.compress(b"\r\n\r\n") + gz.flush()


def read_members(stream) -> Iterator[bytes]:
    """The decompressed members of a gzip stream, one at a time, read ``CHUNK`` bytes at a time."""
    rest = stream.read(CHUNK)
    while rest:
        gz, parts = zlib.decompressobj(31), []
        while not gz.eof:
            if not rest:
                raise ValueError("archive ends inside a record")
            parts.append(gz.decompress(rest))
            rest = gz.unused_data if gz.eof else stream.read(CHUNK)
        yield b"".join(parts)
        rest = rest or stream.read(CHUNK)


def parse_record(member: bytes) -> dict:
    """Fields of one record; raises ValueError where framing or a digest does not hold."""
    head, mark, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not mark or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(fields["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the record")
    if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest does not hold")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(line.split(b":")[1]) for line in http.split(b"\r\n")
                  if line.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != stated or digest != base32_sha1(payload)):
        raise ValueError("payload digest does not hold")
    return {"record_id": fields["warc-record-id"].strip("<>"), "record_type": kind,
            "target_uri": fields.get("warc-target-uri"),
            "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
            "payload_bytes": stated, "payload_digest": digest,
            "payload": payload if kind == "response" else None}


def mark_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                  least_bytes: int = 0, salts: int = 32) -> DataFrame:
    """Pages as (page_id, url, payload, refers_to).

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is
    kept whole and the others refer to it; smaller payloads and pages whose payload has no other
    id refer to nothing. A payload that a third of all pages share is dealt over ``salts``.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"_digest": F.unhex(F.sha1("payload")),
                             "_salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")})
    dealt = rows.groupBy("_digest", "_salt").agg(F.min("page_id").alias("_own"))
    first = dealt.groupBy("_digest").agg(F.min("_own").alias("_first"))
    known = dealt.select("_digest", "_salt").join(first, "_digest")
    revisit = (F.length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(known, ["_digest", "_salt"]).select(
        "page_id", "url", "payload", F.when(revisit, F.col("_first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = 64 << 20,
                   date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write :func:`mark_revisits` rows below ``folder``; one row per finished archive.

    Each task writes files of its own and starts the next at ``archive_bytes``. File names are
    unique per attempt, and only finished files are listed, so a lost or repeated task leaves
    nothing that is read. The result (path, records, bytes) must be stored before it is used.
    Missing page ids get a record id of their own; line breaks in URLs are percent-encoded.
    """
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)

    def write(batches: Batches):
        store, root = open_store(folder)
        out, path, records, size = None, "", 0, 0
        for batch in slices(batches, 64):
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, records, size = f"{folder}/{name}", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                key, refers = row["page_id"], row["refers_to"]
                member = encode_record(
                    f"urn:page:{key}" if key is not None else f"urn:uuid:{uuid.uuid4()}",
                    row["url"], row["payload"], None if refers is None else f"urn:page:{refers}",
                    date)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    yield _listed(path, records, size)
                    out = None
        if out is not None:
            out.close()
            yield _listed(path, records, size)

    return records.mapInArrow(write, "path string, records bigint, bytes bigint")


def _listed(path: str, records: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})


def read_archives(archives: DataFrame, payloads: bool = True, path: str = "path") -> DataFrame:
    """The records of the archives listed in ``path``, in :data:`RECORD_SCHEMA`.

    A task holds one record and a read chunk at a time, whatever the size of its archives.
    Revisits state the length and digest of the payload that they leave out. A record whose
    framing or digest does not hold, or an archive cut short, raises ValueError.
    ``payloads=False`` leaves payloads NULL after they are verified. Each archive is a task.
    """
    def read(batches: Batches):
        for batch in batches:
            for one in batch.column(0).to_pylist():
                store, at = open_store(one)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for member in read_members(stream):
                        row = parse_record(member)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"")
                        if len(rows) >= 2048 or size >= 8 << 20:
                            yield _records(rows)
                            rows, size = [], 0
                if rows:
                    yield _records(rows)

    # By number: adaptive execution would put rows as short as these into a single task.
    return archives.select(path).repartition(max(1, archives.count())).mapInArrow(read, RECORD_SCHEMA)


def _records(rows: list[dict]) -> pa.RecordBatch:
    text = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")
    kinds = pa.schema([(c, pa.string()) for c in text[:4]] + [("payload_bytes", pa.int64()),
                      ("payload_digest", pa.string()), ("payload", pa.binary())])
    return pa.RecordBatch.from_pylist(rows, schema=kinds)


def page_number(record_id: str) -> F.Column:
    """The page id inside a record id, NULL where the page had none."""
    return F.when(F.startswith(F.col(record_id), F.lit("urn:page:")),
                  F.substring(record_id, 10, 40)).cast("bigint")
