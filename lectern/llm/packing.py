"""Packing: concatenate and cut. Prefix sums over partition totals give every document its place in one long row of
ids, which fixed windows cut into sequences; each piece is a boundary record of a document and a window.

The ids are written once to the shared folder (16 bits an id); nothing is shuffled but one total a partition, and
cutting is a map, so a document of any length or a hot source costs no more than its own ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, prepare
from .tokens import part_bases, token_table, unpack
from .workers import tidy

#: Bytes of an Arrow batch, on both sides: several slices of the encoder.
BATCH_BYTES = 4 << 20


def pack(docs: DataFrame, path: str, cut: str = "words", end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: id, start, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset, padded_to.

    A document is its ids and ``end_id``; null or empty text is ``end_id`` alone. Documents follow each other in the
    table's order; a sequence is ``length`` ids, the last one what is left (``padded_to``: its length if that is a power
    of two, else ``length``). Rows with the same or a null id are documents of their own. An empty table has no piece. Of the table
    only these two columns are read: others may have any names, those of the result too.
    """
    spark = prepare(docs.sparkSession, BATCH_BYTES)
    tokens = durable(token_table(docs, id_col, text_col, path, cut, end_id, release_each=True), "pack-ids")
    bases = spark.sparkContext.broadcast(part_bases(tokens))  # 12 bytes a partition
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = bases.value
        total = base[-1]
        tail = total % length
        tail_to = tail if tail and tail & (tail - 1) == 0 else length
        for b in batches:
            rows, starts, ids, sizes, sequences, offsets = [], [], [], [], [], []
            for i, (raw, n, part, before, wide) in enumerate(zip(*(b.column(c).to_pylist() for c in ("ids", "n", "part", "before", "wide")), strict=True)):
                at = base[part] + before
                x = unpack(raw, wide).astype("<u4")
                edges = [0, *range(length - at % length, n, length), n]
                for lo, hi in zip(edges, edges[1:]):
                    rows.append(i)
                    starts.append(lo)
                    ids.append(x[lo:hi].tobytes())
                    sizes.append(n)
                    sequences.append((at + lo) // length)
                    offsets.append((at + lo) % length)
            padded = np.where(np.array(sequences, np.int64) == total // length, tail_to, length)
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col).take(pa.array(rows, pa.int64())), *(pa.array(x, t) for x, t in ((starts, pa.int64()), (ids, pa.binary()), (sizes, pa.int64()), (sequences, pa.int64()), (offsets, pa.int64()), (padded, pa.int64())))],
                names=[id_col, "start", "ids", "doc_tokens", "sequence_id", "offset", "padded_to"],
            )

    return tokens.mapInArrow(tidy(run, each=True), f"`{id_col}` {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long, padded_to long")


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences: sequence_id and ids (binary), pieces joined by offset; at most ``length`` pieces meet in a group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x.ids)).alias("ids"))
