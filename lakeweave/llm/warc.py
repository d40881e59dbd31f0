"""WARC archives of pages: segmented writing with revisit records, and reassembly of the segments when read back."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import column, scratch_dir, written

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry one fixed date: pages have none.
DATE = "2026-01-01T00:00:00Z"
RECORD = "record_id string, kind string, segment int, total long, origin string, refers_to string, uri string, digest string, block binary"
#: What writing leaves: a row for each archive, for each response that others revisit, and for each page whose revisit is still to be written.
WRITTEN = "path string, records long, segmented boolean, key string, record_id string, page_id long, url string, digest string, length long"


def chunked(payload: bytes, size: int = 4096) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c := payload[i : i + size]), c) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            n = int(body[at:end].split(b";")[0].strip(), 16) if end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0:
            return None
        if n == 0:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def http_parts(block: bytes) -> tuple[dict[bytes, bytes], bytes] | None:
    """Header fields (lower-case) and body of an HTTP response block; None if the head has no end."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    return {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}, body


def payload_of(block: bytes) -> bytes | None:
    """Payload of an HTTP response block; None if its framing is broken."""
    parts = http_parts(block)
    if parts is None:
        return None
    fields, body = parts
    return unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def stated_length(block: bytes) -> int | None:
    """The length of the payload that a response's header states, as in revisits."""
    parts = http_parts(block)
    stated = parts[0].get(b"content-length", b"") if parts else b""
    return int(stated) if stated.isdigit() else None


def record(fields: dict[str, object], block: bytes) -> bytes:
    """One gzip member that holds one record."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def _fields(record_id: str, uri: str, digest: str) -> dict[str, object]:
    coded = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    return {"WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, "WARC-Target-URI": _one_line(uri), "WARC-Payload-Digest": coded, "Content-Type": "application/http;msgtype=response"}


def _one_line(uri: str) -> str | None:
    return "".join(uri.split()) or None  # a header is one line


def revisit_record(record_id: str, uri: str, digest: str, length: int, refers_to: str, target: str) -> bytes:
    """A record without payload that names the record with an equal one. Its block is the head of its own response, which states the length."""
    more = {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{refers_to}>", "WARC-Refers-To-Target-URI": _one_line(target), "WARC-Refers-To-Date": DATE}
    return record({"WARC-Type": "revisit", **_fields(record_id, uri, digest), **more}, HTTP + b"Content-Length: %d\r\n\r\n" % length)


def response_records(record_id: str, uri: str, payload: bytes, digest: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page: a response whose block is cut into segments of at most ``segment_bytes``."""
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = {"WARC-Type": "response", **_fields(record_id, uri, digest)}
    if len(block) <= segment_bytes:
        yield record(first, block)
        return
    starts = range(0, len(block), segment_bytes)
    yield record(first | {"WARC-Segment-Number": 1}, block[:segment_bytes])
    for n, at in enumerate(starts[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if n == len(starts) else {}
        yield record({"WARC-Type": "continuation", "WARC-Record-ID": f"<{record_id}:{n}>", "WARC-Date": DATE, "WARC-Target-URI": _one_line(uri), "WARC-Segment-Origin-ID": f"<{record_id}>", "WARC-Segment-Number": n, **last}, block[at : at + segment_bytes])


def parsed(data: bytes, step: int = 1 << 14) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, lower-case, and block of each record of an archive; each byte is inflated once, a slice of ``step`` bytes at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof and at < len(view):
            part = view[at : at + step]
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        raw = b"".join([*out, z.flush()])
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
        yield fields, rest[: int(fields["content-length"])]


def with_roles(pages: DataFrame, least: int = 1000, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, payload, digest, key, and role: 'plain', 'stored' (an equal payload's page revisits it) or 'revisit'.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is stored; rows
    that repeat both are stored each.
    Groups are counted on digests, pre-aggregated; payloads meet the groups in one plain join,
    whose skewed partitions Spark splits.
    """
    payload = F.coalesce(column(html_col), F.lit("")).cast("binary")
    url = F.coalesce(column(url_col), F.lit("")) if url_col in pages.columns else F.lit("")
    base = pages.select(column(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    base = base.select("*", F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("key"), F.octet_length("payload").alias("bytes"))
    groups = base.where(F.col("bytes") >= least).groupBy("key").agg(F.max("page_id").alias("stored"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "stored")
    groups = written(groups, "groups")
    role = F.when(F.col("stored").isNull(), "plain").when(F.col("page_id") == F.col("stored"), "stored").otherwise("revisit")
    return base.join(groups.hint("merge"), "key", "left").select("page_id", "url", "payload", "digest", "key", role.alias("role"))


class _Archives:
    """Files of one kind that a task attempt writes."""

    def __init__(self, folder: str, name: str, segmented: bool, most: int) -> None:
        from pyarrow import fs

        self.folder, self.name, self.segmented, self.most = folder, name, segmented, most
        self.store, self.top = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.top, recursive=True)
        self.buffer: list[bytes] = []
        self.size = self.made = 0

    def add(self, member: bytes) -> Iterator[pa.RecordBatch]:
        self.buffer.append(member)
        self.size += len(member)
        if self.size >= self.most:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.buffer:
            name = f"{self.name}-{self.made}.warc.gz"
            with self.store.open_output_stream(f"{self.top}/{name}", compression=None) as out:
                out.write(b"".join(self.buffer))
            yield _left(path=f"{self.folder}/{name}", records=len(self.buffer), segmented=self.segmented)
            self.buffer, self.size, self.made = [], 0, self.made + 1


def _left(**fields: object) -> pa.RecordBatch:
    """A row of ``WRITTEN``."""
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    names = [x.split() for x in WRITTEN.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([fields.get(n)], types[t]) for n, t in names], [n for n, _ in names])


def _me() -> str:
    """A name that no other task attempt of this stage has."""
    ctx = TaskContext.get()
    return f"{ctx.partitionId()}-{ctx.taskAttemptId()}"


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = 16_384, archive_bytes: int = 16 << 20) -> DataFrame:
    """Write the rows of ``with_roles`` as ``.warc.gz`` files of about ``archive_bytes`` into ``folder``; a manifest (path, records, segmented).

    Responses are written first. What is left of the other pages is a narrow row each, which meets
    the id of the record that holds its payload before its revisit is written: every record that a
    revisit names is in the archives. Every task attempt writes files of its own name, and the
    manifest names those of the attempts that counted, so that a lost executor leaves no double
    records. Records of segmented pages go to archives of their own, so that the reader knows which
    ones to group; those of one page may lie in different archives.
    """

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, row = _me(), 0
        whole, parts = _Archives(folder, f"pages-{me}", False, archive_bytes), _Archives(folder, f"segments-{me}", True, archive_bytes)
        for batch in batches:
            for page_id, url, payload, digest, key, role in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if role == "revisit":
                    yield _left(key=key, page_id=page_id, url=url, digest=digest, length=len(payload))
                    continue
                record_id = f"urn:page:{'' if page_id is None else page_id}:{me}-{row}"
                records = list(response_records(record_id, url, payload, digest, segment_bytes))
                for r in records:
                    yield from (whole if len(records) == 1 else parts).add(r)
                if role == "stored":
                    yield _left(key=key, record_id=record_id, url=url)
                row += 1
        yield from whole.close()
        yield from parts.close()

    def revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, row = _me(), 0
        archives = _Archives(folder, f"revisits-{me}", False, archive_bytes)
        for batch in batches:
            for page_id, url, digest, length, refers_to, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = "" if page_id is None else page_id
                yield from archives.add(revisit_record(f"urn:page:{name}:revisit-{me}-{row}", url, digest, length, refers_to, target))
                row += 1
        yield from archives.close()

    left = written(pages.select("page_id", "url", "payload", "digest", "key", "role").mapInArrow(responses, WRITTEN), "responses")
    stored = left.where("record_id is not null").groupBy("key").agg(F.min(F.struct("record_id", "url")).alias("s")).select("key", F.col("s.record_id").alias("refers_to"), F.col("s.url").alias("target"))
    again = left.where("key is not null and record_id is null").join(stored, "key").select("page_id", "url", "digest", "length", "refers_to", "target")
    more = written(again.mapInArrow(revisits, WRITTEN), "revisits")
    return left.where("path is not null").unionByName(more.where("path is not null")).select("path", "records", "segmented")


def read_records(manifest: DataFrame) -> DataFrame:
    """All records of the archives that ``manifest`` names, as they stand in the files; about one file a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as f:
                    data = f.read()
                rows, size = [], 0
                for h, block in parsed(data):
                    own = h["warc-record-id"].strip("<>")
                    rows.append((own, h["warc-type"], int(h.get("warc-segment-number", 0)), int(x) if (x := h.get("warc-segment-total-length")) else None, h.get("warc-segment-origin-id", own).strip("<>"), (h.get("warc-refers-to") or "").strip("<>") or None, h.get("warc-target-uri"), h.get("warc-payload-digest"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return manifest.select("path").repartitionByRange(max(1, manifest.count()), "path").mapInArrow(run, RECORD)


HEAD = ("kind", "refers_to", "uri", "digest")


def joined(records: DataFrame) -> DataFrame:
    """One row per record that is whole or in segments: record_id, its header fields, block, and joined.

    Segments are grouped by their origin's identifier and joined in the order of their numbers;
    ``joined`` tells that the numbers run from 1 without gaps and the total length is as stated.
    A group is one page, so that no key is hot.
    """
    first = F.col("segment") <= 1
    parts = records.groupBy(F.col("origin").alias("record_id")).agg(
        *(F.max(F.when(first, F.col(c))).alias(c) for c in HEAD),
        F.expr("listagg(block) within group (order by segment)").alias("block"),
        F.countDistinct("segment").alias("n"),
        F.count(F.lit(1)).alias("rows"),
        F.max("segment").alias("last"),
        F.max("total").alias("total"),
    )
    alone = (F.col("last") == 0) & (F.col("rows") == 1)
    sound = F.coalesce(alone | ((F.col("n") == F.col("last")) & (F.col("n") == F.col("rows")) & (F.col("total") == F.octet_length("block"))), F.lit(False))
    return parts.select("record_id", *HEAD, "block", sound.alias("joined"))


def reassemble(records: DataFrame) -> DataFrame:
    """One row per page record: page_id, record_type, refers_to, uri, payload, payload_bytes, payload_digest, whole.

    ``whole`` tells that a record's segments join (see ``joined``), the framing is sound and the
    payload has the digest stated. A revisit has no payload; its digest is the one stated, its
    length the one that its response's header states.
    """
    return decoded(joined(records))


def read_archives(manifest: DataFrame) -> DataFrame:
    """``reassemble``'s rows of the archives that ``write_archives`` made. Every file is read once; only those of segmented pages are grouped."""
    one = read_records(manifest.where("not segmented")).select("record_id", *HEAD, "block", F.lit(True).alias("joined"))
    return decoded(one.unionByName(joined(read_records(manifest.where("segmented")))))


def decoded(blocks: DataFrame) -> DataFrame:
    """Payloads of the joined blocks, checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("page_id", "record_type", "refers_to", "uri", "payload", "payload_bytes", "payload_digest", "whole")}
            for own, kind, refers, uri, digest, block, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = (own or "").split(":")[2:3]
                stated = base64.b32decode(digest.removeprefix("sha1:")).hex() if digest else None
                payload = payload_of(block) if kind == "response" and whole else None
                length = stated_length(block) if kind == "revisit" else len(payload) if payload is not None else None
                hexed = hashlib.sha1(payload).hexdigest() if payload is not None else stated
                sound = whole and (kind == "revisit" or payload is not None and hexed == stated)
                for k, v in zip(out, (int(page[0]) if page and page[0] else None, kind, int(refers.split(":")[2]) if refers else None, uri, payload, length, hexed, bool(sound)), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_()), strict=True)], list(out))

    return blocks.mapInArrow(run, "page_id long, record_type string, refers_to long, uri string, payload binary, payload_bytes long, payload_digest string, whole boolean")


def archive_round_trip(pages: DataFrame, least: int = 1000, segment_bytes: int = 16_384, archive_bytes: int = 16 << 20) -> DataFrame:
    """Write the pages as archives into the shared scratch folder and read them back (``reassemble``'s rows).

    Null html is the empty payload. Repeated rows make a record each; payloads under ``least``
    bytes never make revisits, nor do rows that repeat both the largest page_id and the payload:
    each is a response, and revisits name one of them. A null page_id is kept and never stands for
    another. An empty table gives no rows. Columns other than page_id, url and html are not looked
    at.
    """
    folder = f"{scratch_dir(pages.sparkSession)}/archives"
    return read_archives(write_archives(with_roles(pages, least), folder, segment_bytes, archive_bytes))
