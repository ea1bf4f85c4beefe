"""WARC archives with revisit and continuation records.

Writing: payloads of at least ``DEDUP_BYTES`` are grouped by digest; the group's largest page_id
keeps its response record and the others become revisit records. A response's block is an HTTP
message in chunked transfer framing; a block over ``segment_bytes`` goes on in continuation records.

Reading: whole records are decoded where they are read; segments are grouped by their origin's
record identifier, ordered by segment number, held against the total length, joined and only then
freed from the chunked framing. Payload and digest must agree, or the read raises.

A record ends with two CR LF pairs, which Spark's text writer sets as its line separator, so an
archive is committed by Spark and lives in any store that Spark reaches. That writer compresses an archive
as one gzip member, not a member a record, so archives are read from their start. All records carry the
caller's date. A revisit names its original by WARC-Refers-To-Target-URI and by page, not by record.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ._scratch import materialize, ship, tidy
from ._skew import salted_join

DEDUP_BYTES = 1000
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 4096
#: Bytes of an archive before compression, about, and of the records that one row brings to the writer.
ARCHIVE_BYTES = 64 << 20
ROW_BYTES = 2 << 20
#: Groups of copies that are broadcast, some 200 bytes each, so that no payload is shuffled; beyond, payloads are joined by salts, so many of a group to a task.
BROADCAST_GROUPS = 200_000
DATE = "1970-01-01T00:00:00Z"

RECORD_SCHEMA = "record_id string, origin_id string, segment int, total_length long, record_type string, page_id long, url string, refers_to long, refers_to_url string, digest string, block binary"


def mark_revisits(pages: DataFrame, least: int = DEDUP_BYTES) -> DataFrame:
    """page_id, url, payload (null html: empty), digest, ``refers_to`` and ``refers_to_url``; the last two are null for responses.

    Rows without page_id count as the smallest; where none of a group has one, all are responses.
    Every row that repeats the largest page_id of its group is a response. Other columns are never read; an
    empty table gives an empty one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    # Groups are found on narrow rows.
    groups = rows.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("last")).filter("n > 1 and last.page_id is not null")
    groups = materialize(groups, "warc-groups", small=True)
    few = groups.count() <= BROADCAST_GROUPS
    found = rows.join(F.broadcast(groups), "digest", "left") if few else salted_join(rows, groups, ["digest"], "n", "page_id", "left")
    last = F.col("last")
    revisit = last.isNotNull() & ~F.col("page_id").eqNullSafe(last["page_id"])
    return found.select("page_id", "url", "payload", F.coalesce("digest", F.sha1("payload")).alias("digest"), F.when(revisit, last["page_id"]).alias("refers_to"), F.when(revisit, last["url"]).alias("refers_to_url"))


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Undo chunked framing; raises ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its length says")
        parts.append(body[at : at + size])
        at += size + 2


def _uri(url: str | None) -> str:
    return "".join(x for x in url or "" if x.isprintable() and x != " ")


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_to_url: str | None, name: str, segment_bytes: int = SEGMENT_BYTES, date: str = DATE) -> Iterator[bytes]:
    """The records of a page, each without its closing CR LF pairs."""
    record = f"<urn:plumbline:{name}>"
    target, original = _uri(url), _uri(refers_to_url)
    common = [("WARC-Date", date), *([("WARC-Target-URI", target)] if target else []), *([("X-Page-ID", page_id)] if page_id is not None else [])]

    def made(kind: str, fields: list, block: bytes, own: str) -> bytes:
        lines = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Record-ID", own), *common, *fields, ("Content-Length", len(block))])
        return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block

    typed = ("Content-Type", "application/http;msgtype=response")
    sha = ("WARC-Payload-Digest", f"sha1:{digest}")
    if refers_to is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        yield made("revisit", [typed, sha, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *([("WARC-Refers-To-Target-URI", original)] if original else []), ("X-Refers-To-Page", refers_to)], head, record)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield made("response", [typed, sha], block, record)
        return
    starts = range(0, len(block), segment_bytes)
    for k, at in enumerate(starts, 1):
        part = block[at : at + segment_bytes]
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(starts) else []
        if k == 1:
            yield made("response", [typed, sha, ("WARC-Segment-Number", 1)], part, record)
        else:
            yield made("continuation", [("WARC-Segment-Origin-ID", record), ("WARC-Segment-Number", k), *last], part, f"<urn:plumbline:{name}:{k}>")


def write_archives(marked: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> None:
    """Write the rows of ``mark_revisits`` as archives below ``path``. An empty table writes no record."""
    ship(marked.sparkSession)
    row_bytes = min(ROW_BYTES, archive_bytes)

    def records(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, row, out, held = TaskContext.get().partitionId(), 0, [], 0
        joined = lambda: pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(out)], pa.binary())], names=["records"])
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row += 1
                for r in records_of(*values, f"{part}-{row}", segment_bytes, date):
                    out.append(r)
                    held += len(r) + 4
                    if held >= row_bytes:
                        yield joined()
                        out, held = [], 0
        if out:
            yield joined()

    rows = marked.select("page_id", "url", "payload", "digest", "refers_to", "refers_to_url").mapInArrow(tidy(records), "records binary")
    rows.select(F.col("records").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, archive_bytes // row_bytes)).option("compression", "gzip").text(path)


def parse(content: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, compressed or not."""
    raw, at = gzip.decompress(content) if bytes(content[:2]) == b"\x1f\x8b" else bytes(content), 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(head["content-length"])
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield head, raw[end + 4 : stop]
        at = stop + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records as RECORD_SCHEMA; ``segment`` is null for records that aren't segmented."""
    ship(spark)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def number(head: dict, key: str) -> int | None:
            return int(head[key]) if key in head else None

        names = ["record_id", "origin_id", "segment", "total_length", "record_type", "page_id", "url", "refers_to", "refers_to_url", "digest", "block"]
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

        def table(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block in parse(content.as_buffer()):
                    sha = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    rows.append((head["warc-record-id"], head.get("warc-segment-origin-id", head["warc-record-id"]), number(head, "warc-segment-number"), number(head, "warc-segment-total-length"), head["warc-type"], number(head, "x-page-id"), head.get("warc-target-uri"), number(head, "x-refers-to-page"), head.get("warc-refers-to-target-uri"), sha, block))
                    held += len(block)
                    if held > 8 << 20:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    try:
        files = spark.read.format("binaryFile").load(f"{path}/part-*").select("content")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RECORD_SCHEMA)
    return files.mapInArrow(tidy(read), RECORD_SCHEMA)


def reassemble(records: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload, payload_bytes and payload_digest of each response or revisit.

    A revisit holds no payload (null); its size and digest are its header's, those of the full payload.
    Segments are brought together by their origin's record, of which a page has one: a long page is one task's
    list, as it was one row before. A segment that is missing or repeated raises. Repeated pages are records
    of their own. No records give an empty table.
    """
    ship(records.sparkSession)
    parts = F.sort_array(F.collect_list(F.struct("segment", "total_length", "record_type", "page_id", "url", "digest", "block")))
    kept = ["record_type", "page_id", "url", "refers_to", "digest"]
    schema = "record_type string, page_id long, url string, refers_to long, digest string, payload binary, payload_bytes long"

    def whole(batches: Iterator) -> Iterator:
        return decoded(batches, False)

    def joined(batches: Iterator) -> Iterator:
        return decoded(batches, True)

    def decoded(batches: Iterator, segmented: bool) -> Iterator:
        import hashlib

        import pyarrow as pa

        names = ["record_type", "page_id", "url", "refers_to", "digest", "payload", "payload_bytes"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if segmented:
                    parts = x["parts"]
                    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                        raise ValueError("a segment is missing or repeated")
                    x = parts[0] | {"refers_to": None, "block": b"".join(p["block"] for p in parts)}
                    if len(x["block"]) != parts[-1]["total_length"]:
                        raise ValueError("the segments don't add up to their total length")
                head, _, body = x["block"].partition(b"\r\n\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
                payload, n = None, int(fields.get(b"content-length", 0))
                if x["record_type"] != "revisit":
                    payload = unchunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                    n = len(payload)
                    if hashlib.sha1(payload).hexdigest() != x["digest"]:
                        raise ValueError("a payload isn't that of its digest")
                rows.append((x["record_type"], x["page_id"], x["url"], x["refers_to"], x["digest"], payload, n))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    single = records.filter("segment is null").select(*kept, "block").mapInArrow(tidy(whole), schema)
    many = records.filter("segment is not null").groupBy("origin_id").agg(parts.alias("parts")).select("parts").mapInArrow(tidy(joined), schema)
    return single.unionByName(many).withColumnRenamed("digest", "payload_digest")
