"""WARC 1.1 archives, one gzip member a record, with a splittable reader.

Reader method: a task gets a byte range of an archive, scans it for the gzip magic, validates each candidate by
inflating its first bytes and looking for a WARC header (compressed data can hold the magic by chance), and owns the
records whose members start inside its range; it reads past its end to finish the last of them, and goes on from a member's end.
A payload may itself hold whole members uncompressed. A range that begins inside such a payload takes them for records at first; but they
lie inside a member of an earlier range, so every candidate before the farthest end of the ranges before it is dropped. After that the members
of a file must cover it.

Writer: one archive a task, under a name of its own attempt; the manifest holds only the files of attempts that
succeeded, so a lost executor leaves at most an unlisted file. Equal payloads of ``revisit_bytes`` or more are stored
once; the others become revisit records (identical-payload-digest profile).

A member with a WARC header that doesn't inflate, a payload that differs from its digest, bytes that no member covers, and record counts that differ
from the manifest's raise, or with ``errors="rows"`` become rows with a text in ``error``. Records of foreign archives have a null page_id where
their id is no number; those without an HTTP block have the whole block as payload.

Defined results: null payloads count as empty; an empty table gives no archive and no rows; equal page_ids are separate
records; extra columns are ignored; a null url is written as urn:page:<id>.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import blank, join_groups, materialise, open_store, scratch

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes that a candidate may need before its WARC header is inflated.
PROBE = 4096
#: Bytes that a member is inflated by at a time.
PIECE = 1 << 14


def encode_record(page_id, url, payload: bytes, digest_hex: str, refers_to, date: str) -> bytes:
    """One gzip member; refers_to (a page_id) makes it a revisit, which keeps the HTTP header and drops the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest_hex)).decode()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(5, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def write_archives(pages: DataFrame, directory: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages: (page_id, url, payload binary, payload_digest, refers_to). Writes; returns the manifest (path, bytes, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, size = None, 0, 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for page_id, url, payload, digest, refers_to in zip(*columns):
                if out is None:
                    uri = f"{directory}/{uuid.uuid4().hex}.warc.gz"
                    store, path = open_store(uri)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                member = encode_record(page_id, url, payload, digest, refers_to, date)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [uri], "bytes": [size], "records": [n]})

    rows = pages.select("page_id", "url", "payload", "payload_digest", "refers_to")
    return materialise(rows.mapInArrow(write, "path string, bytes long, records long"), "warc-manifest")


def _member(file, start: int, size: int, data: memoryview) -> tuple[int, bytes] | None:
    """(end, bytes) of the WARC member at start; None if it isn't one; raises zlib.error or EOFError if it breaks off. data: bytes from there on."""
    inflate = zlib.decompressobj(31)
    try:
        parts = [inflate.decompress(data[:PROBE], 256)]
    except zlib.error:
        return None
    if not parts[0].startswith(b"WARC/1."):
        return None
    fed, rest = min(len(data), PROBE), inflate.unconsumed_tail
    while not inflate.eof:
        if not rest:
            if fed < len(data):
                rest = data[fed : fed + PIECE]
            else:
                file.seek(start + fed)
                rest = file.read(min(PIECE, size - start - fed))
            if not rest:
                raise EOFError("the file ends inside a member")
            fed += len(rest)
        parts.append(inflate.decompress(rest))
        rest = inflate.unconsumed_tail
    return start + fed - len(inflate.unused_data), b"".join(parts)


def _header(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = fields.get("content-length", "")
    return fields, block[: int(length)] if length.isdigit() else block


def members_in_range(uri: str, start: int, end: int, size: int) -> Iterator[tuple[int, int | None, bytes | str]]:
    """(offset, end, bytes) of the members that start in [start, end); end is None, and bytes the error, for one that breaks off."""
    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        f.seek(start)
        data = f.read(min(end - start + PROBE, size - start))
        view = memoryview(data)
        at = data.find(MAGIC)
        while 0 <= at < end - start:
            try:
                found = _member(f, start + at, size, view[at:])
            except (zlib.error, EOFError) as e:
                yield start + at, None, str(e)
                found = None
            if found is not None:
                yield start + at, *found
            at = data.find(MAGIC, at + 1 if found is None else found[0] - start)


def _record(raw: bytes, payloads: bool) -> tuple:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, error."""
    fields, block = _header(raw)

    def number(field: str) -> int | None:
        found = fields.get(field, "").rpartition(":")[2].rstrip(">")
        return int(found) if found.isdecimal() or found[:1] == "-" and found[1:].isdecimal() else None

    http, payload = None, block
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    kind, length, error = fields.get("warc-type"), len(payload), None
    algorithm, _, value = fields.get("warc-payload-digest", "").partition(":")
    digest = base64.b32decode(value).hex() if algorithm.lower() == "sha1" and re.fullmatch("[A-Z2-7]{32}", value) else None
    if kind == "revisit":
        named = [x.split(b":")[1].strip() for x in (http or b"").split(b"\r\n") if x.lower().startswith(b"content-length:")]
        length, payload = int(named[0]) if named and named[0].isdigit() else None, None
    elif digest is None:
        digest = hashlib.sha1(payload).hexdigest()
    elif hashlib.sha1(payload).hexdigest() != digest:
        error = "the payload differs from its digest"
    return number("warc-record-id"), fields.get("warc-target-uri"), kind, number("warc-refers-to"), length, digest, payload if payloads else None, error


def read_archives(manifest: DataFrame, split_bytes: int = 8 << 20, payloads: bool = True, errors: str = "raise") -> DataFrame:
    """manifest: (path, bytes[, records]). Rows: page_id, url, record_type, refers_to, payload_bytes, payload_digest (hex), payload (null for revisits, or
    unless payloads), offset, path, error."""
    splits = manifest.filter("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("split"))
    tasks = max(1, splits.count())
    splits = splits.repartition(min(tasks, 100_000))
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "error", "offset", "end", "split", "path"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string, offset long, end long, split long, path string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        rows, held = [], 0
        for b in batches:
            for path, size, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                for offset, end, raw in members_in_range(path, start, min(start + split_bytes, size), size):
                    own = (*[None] * 7, raw) if end is None else _record(raw, payloads)
                    rows.append((*own, offset, end, start, path))
                    held += len(own[6] or b"")
                    if held > 8 << 20 or len(rows) >= 2000:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    rows = materialise(splits.mapInArrow(read, schema), "warc-records")
    # a row a split: how far the ranges before it reach
    reach = rows.groupBy("path", "split").agg(F.max("end").alias("last"), F.min("offset").alias("first"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = reach.withColumn("covered", F.max("last").over(before)).filter("first < covered").select("path", "split", "covered")
    rows = rows.join(materialise(inside, "warc-covered"), ["path", "split"], "left").filter("covered is null or offset >= covered")
    per = rows.groupBy("path").agg(F.sum(F.col("end") - F.col("offset")).alias("held"), F.count("end").alias("members"), F.count("error").alias("broken"), F.first("error", True).alias("why"))
    wanted = manifest.select("path", "bytes", *(["records"] if "records" in manifest.columns else [F.lit(None).cast("long").alias("records")]))
    wrong = wanted.join(per, "path", "left").filter("coalesce(held, 0) <> bytes or records <> coalesce(members, 0) or broken > 0")
    wrong = wrong.select("path", F.format_string("%s of %s bytes in %s members, of %s records; %s broken: %s", F.coalesce("held", F.lit(0)), "bytes", F.coalesce("members", F.lit(0)), "records", F.coalesce("broken", F.lit(0)), "why").alias("error"))
    out = rows.select(*names[:7], "offset", "path", "error")
    if errors == "rows":
        return out.unionByName(wrong, allowMissingColumns=True)
    if found := wrong.limit(5).collect():
        raise ValueError("; ".join(f"{r['path']}: {r['error']}" for r in found))
    return out


def plan_revisits(pages: DataFrame, revisit_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Payload, digest and refers_to of each page: among equal payloads the largest page_id is the response."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(blank(text_col), "UTF-8").alias("payload"),
        F.sha1(blank(text_col)).alias("payload_digest"),
        # SHA-1 goes into the records; what is equal is told by SHA-256
        F.sha2(blank(text_col), 256).alias("same"),
    )
    groups = rows.filter(F.octet_length("payload") >= revisit_bytes).groupBy("same")
    groups = materialise(groups.agg(F.max("page_id").alias("keep_id"), F.count("*").alias("copies")).filter("copies > 1"), "payload-groups")
    out = join_groups(rows, groups, "same", "copies")
    refers = F.when(F.col("keep_id").isNotNull() & ~F.col("keep_id").eqNullSafe(F.col("page_id")), F.col("keep_id"))
    return out.select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def round_trip(pages: DataFrame, directory: str | None = None, payloads: bool = True, **names) -> DataFrame:
    """Writes pages as archives and reads them back through byte ranges."""
    directory = directory or scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_revisits(pages, **names), directory), payloads=payloads)
