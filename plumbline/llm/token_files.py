"""Token-id files: patched frame-of-reference blocks with an index of block starts.

A file is a row of segments, each closed by ``SEPARATOR``. A segment holds whole documents:

    magic "PFR1", then little-endian: file number u32, segment u32, documents u32, ids u64,
    block size u32, blocks u32, body bytes u64, mask u8, crc32 of all that follows u32
    has-id flags u8[documents], document ids i64[documents], lengths u64[documents]
    block minima u32[blocks], widths u8[blocks], exceptions u16[blocks], block starts u64[blocks + 1]
    body: for each block its packed values, then exception positions u16, then exception values u32

In a block of 128 ids the minimum is subtracted; the width is what the value at the block's 90th
percentile needs, wider values leave their low bits in place and stand whole in the exception list.
Packed values are 64-bit words, little-endian, value i at bit i * width. The index allows any
range of ids to be read without decoding the blocks before it. What follows the head is combined with
the mask by exclusive or; it is 0 unless the separator would stand within the segment.

Spark's own text writer commits the bytes and its text reader gives segments back, so files live in
any store that Spark reaches, a lost executor leaves no half-written file behind, and a reader holds a
segment, not a file.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ._scratch import materialize, ship, tidy

MAGIC = b"PFR1"
SEPARATOR = "\n--PFR1 segment ends--\n"
HEAD = struct.Struct("<4sIIIQIIQBI")
BLOCK = 128
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 20
#: UTF-8 bytes of text that go to one file, about; more where there would be over MOST_FILES files.
FILE_BYTES = 32 << 20
MOST_FILES = 100_000


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value below 2**32 needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values of ``width`` bits to (blocks, BLOCK * width / 8) bytes."""
    columns = np.ascontiguousarray(values.T.astype(np.uint64))
    words = np.zeros((BLOCK * width // 64, len(values)), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        words[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(values), BLOCK * width // 8)


def _unpack(raw: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(raw).view("<u8").T)
    out = np.empty((BLOCK, len(raw)), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[word + 1] << np.uint64(64 - shift)
        out[i] = value & mask
    return out.T.astype(np.uint32)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of the sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def encode_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, file_no: int = 0, segment: int = 0) -> bytes:
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.concatenate([ids, np.repeat(ids[-1:], n_blocks * BLOCK - len(ids))]).astype(np.uint32).reshape(n_blocks, BLOCK)
    minima = padded.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    deltas = padded - minima[:, None]
    at = min(BLOCK - 1, int(PERCENTILE * BLOCK))
    widths = _bits(np.partition(deltas, at, axis=1)[:, at]) if n_blocks else np.zeros(0, np.uint8)
    patched = deltas.astype(np.uint64) >> widths.astype(np.uint64)[:, None] > 0
    counts = patched.sum(axis=1)
    sizes = widths.astype(np.int64) * (BLOCK // 8) + counts * 6
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    body = np.zeros(int(starts[-1]), np.uint8)
    for width in np.unique(widths[widths > 0]).tolist():
        mine = np.flatnonzero(widths == width)
        packed = _pack(deltas[mine] & np.uint32((1 << width) - 1), width)
        body[starts[mine][:, None] + np.arange(packed.shape[1])] = packed
    if counts.any():
        of, position = np.nonzero(patched)
        lists = starts[:-1] + widths.astype(np.int64) * (BLOCK // 8)
        place = _within(counts)
        body[(lists[of] + 2 * place)[:, None] + np.arange(2)] = position.astype("<u2").view(np.uint8).reshape(-1, 2)
        body[(lists[of] + 2 * counts[of] + 4 * place)[:, None] + np.arange(4)] = deltas[patched].astype("<u4").view(np.uint8).reshape(-1, 4)
    rest = b"".join([
        np.array([x is not None for x in doc_ids], np.uint8).tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.asarray(lengths, "<u8").tobytes(),
        minima.astype("<u4").tobytes(), widths.astype(np.uint8).tobytes(), counts.astype("<u2").tobytes(), starts.astype("<u8").tobytes(), body.tobytes(),
    ])
    for mask in range(256):
        masked = (np.frombuffer(rest, np.uint8) ^ np.uint8(mask)).tobytes() if mask else rest
        made = HEAD.pack(MAGIC, file_no, segment, len(doc_ids), len(ids), BLOCK, n_blocks, len(body), mask, zlib.crc32(masked)) + masked
        if SEPARATOR.encode() not in made:
            return made
    raise ValueError("no mask keeps the separator out of a segment")


class Segment:
    """A segment in memory: its documents, and any range of its ids."""

    def __init__(self, data: memoryview):
        magic, self.file_no, self.number, n_docs, self.n_ids, block, n_blocks, body, mask, crc = HEAD.unpack_from(data)
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a token segment")
        if zlib.crc32(data[HEAD.size :]) != crc:
            raise ValueError("a token segment is damaged")
        if mask:
            data = bytes(HEAD.size) + (np.frombuffer(data, np.uint8, -1, HEAD.size) ^ np.uint8(mask)).tobytes()
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        flags, ids = take("u1", n_docs), take("<i8", n_docs)
        self.doc_ids = [i if f else None for i, f in zip(ids.tolist(), flags.tolist(), strict=True)]
        self.lengths = take("<u8", n_docs).astype(np.int64)
        self.minima, self.widths, self.counts = take("<u4", n_blocks), take("u1", n_blocks), take("<u2", n_blocks).astype(np.int64)
        self.starts = take("<u8", n_blocks + 1).astype(np.int64)
        self.body = take("u1", body)

    def read(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids ``lo`` to ``hi`` of the segment; only the blocks that hold them are decoded."""
        hi = self.n_ids if hi is None else min(hi, self.n_ids)
        if lo >= hi:
            return np.zeros(0, np.uint32)
        first, last = lo // BLOCK, -(-hi // BLOCK)
        widths, counts, starts = self.widths[first:last], self.counts[first:last], self.starts[first:last]
        out = np.zeros((last - first, BLOCK), np.uint32)
        for width in np.unique(widths[widths > 0]).tolist():
            mine = np.flatnonzero(widths == width)
            out[mine] = _unpack(self.body[starts[mine][:, None] + np.arange(BLOCK // 8 * width)], width)
        if counts.any():
            of, place = np.repeat(np.arange(len(counts)), counts), _within(counts)
            lists = starts + widths.astype(np.int64) * (BLOCK // 8)
            position = self.body[(lists[of] + 2 * place)[:, None] + np.arange(2)].view("<u2").ravel()
            out[of, position] = self.body[(lists[of] + 2 * counts[of] + 4 * place)[:, None] + np.arange(4)].view("<u4").ravel()
        out += self.minima[first:last, None]
        return out.ravel()[lo - first * BLOCK : hi - first * BLOCK]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, text: str = "text", doc_id: str = "doc_id", file_bytes: int = FILE_BYTES) -> None:
    """Write every whole text's ids and its end id in ascending ``doc_id`` order (nulls first) below ``path``.

    Texts are dealt by ranges of id before they are encoded, once; the second key only splits rows
    that repeat one id. A null text is empty: its end id alone. An empty table writes no segment.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))
    total = narrow.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    tie = F.xxhash64("t")
    ordered = narrow.repartitionByRange(min(MOST_FILES, max(1, math.ceil(total / file_bytes))), F.col("d").asc_nulls_first(), tie).sortWithinPartitions(F.col("d").asc_nulls_first(), tie)

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from plumbline.llm._tokens import encoder

        enc, file_no, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        docs, lengths, ids, held = [], [], [], 0

        def flush() -> Iterator:
            nonlocal number, held
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array([encode_segment(docs, np.concatenate(lengths), np.concatenate(ids), file_no, number)], pa.binary())], names=["segment"])
                number, held = number + 1, 0
                docs.clear(), lengths.clear(), ids.clear()

        for batch in batches:
            for a, b, counts, got in enc.groups(batch.column(1)):
                ends = np.cumsum(counts)
                ids.append(np.insert(got, ends, end_id).astype(np.uint32))
                lengths.append(counts + 1)
                docs.extend(batch.column(0).slice(a, b - a).to_pylist())
                held += len(ids[-1])
                if held >= SEGMENT_IDS:
                    yield from flush()
        yield from flush()

    ordered.mapInArrow(tidy(write), "segment binary").select(F.col("segment").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document from the files: doc_id, file_no, segment, place (in its segment), before (ids before it in its segment), n_tokens, ids_crc32 and, if asked for, ids (binary)."""
    ship(spark)
    schema = "doc_id long, file_no int, segment int, place int, before long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                s = Segment(memoryview(content.as_buffer()))
                ids = s.read().astype("<u4", copy=False)
                raw, ends = memoryview(ids).cast("B"), np.cumsum(s.lengths)
                parts = [raw[(e - n) * 4 : e * 4] for e, n in zip(ends.tolist(), s.lengths.tolist(), strict=True)]
                n = len(parts)
                out = [
                    pa.array(s.doc_ids, pa.int64()), pa.array(np.full(n, s.file_no, np.int32)), pa.array(np.full(n, s.number, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(ends - s.lengths), pa.array(s.lengths), pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                ]
                if with_ids:
                    out.append(pa.array([bytes(x) for x in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "file_no", "segment", "place", "before", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("segment")).mapInArrow(tidy(read), schema)


def document_starts(read: DataFrame) -> DataFrame:
    """``read`` with ``start``: the ids of all documents before, over segments in their order.

    Segments are summed within their file first; the one window over all rows is over one row a file.
    """
    table = materialize(read, "token-index")
    parts = table.groupBy("file_no", "segment").agg(F.sum("n_tokens").alias("_ids"))
    files = parts.groupBy("file_no").agg(F.sum("_ids").alias("_ids"))
    files = files.select(F.col("file_no").alias("_file"), F.coalesce(F.sum("_ids").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_ids").over(W.partitionBy("file_no").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_inside", inside).join(files, F.col("file_no") == F.col("_file")).select(F.col("file_no").alias("_file"), F.col("segment").alias("_segment"), (F.col("_before") + F.col("_inside")).alias("_before"))
    placed = table.join(parts, (F.col("file_no") == F.col("_file")) & (F.col("segment") == F.col("_segment")))
    return placed.withColumn("start", F.col("_before") + F.col("before")).drop("_before", "_file", "_segment", "before")
