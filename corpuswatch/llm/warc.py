"""WARC archives with an index of byte ranges: written record by record, read back by coalesced ranges."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import KeyFilter, column_or_empty, new_folder, partitions, slices, written

INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
FOUND = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Records apart by less than this are read at once, up to so many bytes.
GAP, BLOCK = 64 << 10, 8 << 20
#: Archive bytes that one task reads.
SHARE = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _target(url: str | None) -> str:
    """A header holds no control or space: these are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url or "")


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One gzip member with one record; a revisit holds the headers of the response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {sha1}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_target(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            head += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {sha1}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    """A record's fields and payload; the payload's digest is verified where it is there."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    names = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(names["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    sha1, kind = names["WARC-Payload-Digest"].removeprefix("sha1:"), names["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != sha1):
        raise ValueError(f"record {names['WARC-Record-ID']} has another payload than its digest says")
    number = lambda k: int(names[k]) if k in names else None
    return {
        "page_id": number("X-Page-ID"), "url": names["WARC-Target-URI"], "payload_bytes": size, "payload_digest": sha1,
        "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if kind == "response" else None,
    }


def ranges(wanted: list[tuple[int, int]], gap: int = GAP, block: int = BLOCK) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(offset, length, members) of reads that cover ``wanted`` (sorted offset, length): near ones are read together, up to ``block`` bytes."""
    start = end = None
    members: list[tuple[int, int]] = []
    for offset, length in wanted:
        if members and (offset - end > gap or offset + length - start > block):
            yield start, end - start, members
            members = []
        if not members:
            start = end = offset
        members.append((offset, length))
        end = max(end, offset + length)
    if members:
        yield start, end - start, members


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _open(path: str):
    from pyarrow import fs

    found, inner = fs.FileSystem.from_uri(path)
    return found, inner


def decisions(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """_key and _refers for each payload that over one page has: the largest page_id of those with at least ``min_bytes`` bytes."""
    groups = pages.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_refers"), F.max("_bytes").alias("_b"))
    return groups.where((F.col("_n") > 1) & (F.col("_b") >= min_bytes)).select("_key", "_refers")


def payloads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(column_or_empty(html_col), "utf-8").alias("payload"))
    return base.withColumn("_key", F.sha1("payload")).withColumn("_bytes", F.octet_length("payload").cast("long"))


def referred(base: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload and _refers, the page whose record is the response for that payload (null where it stands alone)."""
    dups = written(decisions(base.select("page_id", "_key", "_bytes"), min_bytes), "warc-shared")
    marked = KeyFilter(dups.select(F.xxhash64("_key"))).mark(base, "_shared", F.xxhash64("_key"))
    alone = marked.where("not _shared").select("page_id", "url", "payload", F.lit(None).cast("long").alias("_refers"))
    return alone.unionByName(marked.where("_shared").join(dups, "_key", "left").select("page_id", "url", "payload", "_refers"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of ``pages`` into archives under ``folder`` and returns their index (``INDEX``), itself a written table.

    Each task writes one archive under a name of its own, record after record,
    and gives an index row for each; a task that is run again writes another
    archive, and only those in the index count. Of equal payloads (SHA-1 and
    length) of at least ``min_bytes`` bytes the largest page_id is a response and the others
    revisit it; of rows repeated with that page_id each is a response.
    Null html is an empty payload, a null url an empty target; null page_ids
    revisit any other, or are responses where no row of the payload has an id.

    Payloads that stand alone go straight into an archive; only rows of shared
    ones are shuffled. What each of those becomes is written before its rows are joined to it,
    so that a payload that a third of all pages share is split over tasks.
    """
    rows = referred(payloads(pages, id_col, url_col, html_col), min_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, offset = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in slices(batches):
            index = []
            if out is None and batch.num_rows:
                where, inner = _open(name)
                where.create_dir(inner.rpartition("/")[0], recursive=True)
                out = where.open_output_stream(inner, compression=None, buffer_size=1 << 20)
            for row in batch.to_pylist():
                payload, target = row["payload"], row["_refers"]
                revisit = target is not None and row["page_id"] != target
                sha1 = digest(payload)
                data = record(row["page_id"], row["url"], payload, sha1, target, revisit, date)
                out.write(data)
                index.append((name, offset, len(data), row["page_id"], row["url"], sha1, "revisit" if revisit else "response"))
                offset += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), index_schema.types, strict=True)] if index else [pa.array([], t) for t in index_schema.types], schema=index_schema)
        if out is not None:
            out.close()

    index_schema = arrow_schema(INDEX)
    return written(rows.mapInArrow(write, INDEX), "warc-index")


def read_warc(index: DataFrame, gap: int = GAP, block: int = BLOCK) -> DataFrame:
    """The records that the rows of ``index`` (all, or a selection) point at, as ``FOUND``.

    Rows are dealt by ranges of (file, offset) and sorted, so that a task
    reads each archive forward: neighbouring records come in one read of at
    most ``block`` bytes (more only for a single record that is longer). Each
    payload is verified by its digest.
    """
    schema = arrow_schema(FOUND)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, handle = None, None
        for batch in batches:
            at = batch.to_pylist()
            for file in dict.fromkeys(x["file"] for x in at):
                if file != name:
                    where, inner = _open(file)
                    name, handle = file, where.open_input_file(inner)
                for start, length, members in ranges([(x["offset"], x["length"]) for x in at if x["file"] == file], gap, block):
                    data = io.BytesIO(handle.read_at(length, start)).getbuffer()
                    found = [parse(bytes(data[o - start : o - start + n])) for o, n in members]
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(partitions(index.sparkSession), -(-total // SHARE))  # by the bytes behind the rows, which the rows' own size doesn't tell
    dealt = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, FOUND)


def archive(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return new_folder(spark, "warc")
