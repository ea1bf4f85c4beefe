"""Token counts: batch encoding in Arrow functions that return lengths only.

Rows are encoded in groups balanced by bytes; a text of more than ``SPLIT_BYTES`` is first cut
where the tokenizer cuts anyway and its parts are counted apart, so no group outgrows memory.
No shuffle: one pass over the scan, of which only the kept columns and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, functions as F

from ._scratch import ship, tidy

SPLIT_BYTES = 1 << 20


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_bytes`` (UTF-8) and ``n_tokens`` of each whole text.

    ``tokenizer``: path of a tokenizer file that every executor can read. A null text counts as
    empty (0, 0); nulls in other columns pass through; repeated rows give repeated results; an
    empty table gives an empty one; other columns are never read, whatever their names.
    """
    ship(docs.sparkSession)
    kept = [f"k{i}" for i in range(len(keep))]
    narrow = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(f"`{text}`").cast("string").alias("t"))
    schema = ", ".join([*(f"{k} {narrow.schema[k].dataType.simpleString()}" for k in kept), "n_bytes long", "n_tokens long"])

    def lengths(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from plumbline.llm._tokens import encoder, safe_pieces

        enc = encoder(tokenizer)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            n_bytes = np.array(pc.fill_null(pc.binary_length(column), 0), np.int64)
            of, parts = np.arange(len(column)), column
            if (n_bytes > SPLIT_BYTES).any():
                cut = [safe_pieces(x or b"", SPLIT_BYTES, enc.drops_space) for x in column.cast(pa.binary()).to_pylist()]
                of = np.repeat(of, [len(x) for x in cut])
                parts = pa.array([p for x in cut for p in x], pa.binary()).cast(pa.string())
            n_tokens = np.zeros(len(column), np.int64)
            for a, b, counts, _ in enc.groups(parts, counting=True):
                np.add.at(n_tokens, of[a:b], counts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_bytes), pa.array(n_tokens)], names=[*kept, "n_bytes", "n_tokens"])

    return narrow.mapInArrow(tidy(lengths), schema).withColumnsRenamed(dict(zip(kept, keep, strict=True)))
