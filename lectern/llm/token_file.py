"""Token-ID files: a static range asymmetric numeral system with shared frequency tables.

File (little-endian): magic ``LRNS0001``; five unsigned 64-bit numbers: documents, ids, id of the first token in the
whole row of ids, blocks, bytes of the packed header; the header, zlib-compressed: document ids (int64), null flags
(bytes), ids a document (uint32), then the table: symbols (uint32) and their frequencies (uint32), and the checkpoints:
for each block the words before it (uint64), its ids (uint32) and the CRC-32 of its bytes (uint32); the CRC-32 of the
compressed header; the blocks.

A block holds ``LANES`` interleaved coders' last states (uint64) and their common 32-bit words in decoding order, so
each block is decoded on its own, and many blocks at a time by numpy. Frequencies sum to 2**``BITS``.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, shared_dir
from .tokens import part_bases, token_table, unpack
from .workers import tidy

MAGIC = b"LRNS0001"
BITS, LANES, STEPS, AT_ONCE = 20, 32, 512, 64
BLOCK = LANES * STEPS
LOW = np.uint64(1 << 31)
U64 = np.uint64


def frequency_table(symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**BITS, in proportion to ``counts`` as near as can be."""
    total = 1 << BITS
    if len(counts) > total:
        raise ValueError("too many symbols")
    freq = np.maximum(1, np.floor(counts / counts.sum() * total)).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    while (gap := total - int(freq.sum())) != 0:
        if gap > 0:
            freq[order[0]] += gap
        else:
            can = order[freq[order] > 1]
            take = np.minimum(freq[can] - 1, np.maximum(1, freq[can] * -gap // freq[can].sum()))
            take = np.where(np.cumsum(take) <= -gap, take, np.maximum(0, -gap - (np.cumsum(take) - take)))
            freq[can] -= take
    return freq.astype(np.uint32)


class Coder:
    """Encodes and decodes blocks of symbols under one table."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint32)
        self.wide = self.freq.astype(U64)
        self.cum = np.cumsum(self.wide) - self.wide
        self.slots = self.places = None

    def encode(self, ids: np.ndarray) -> list[bytes]:
        """One bytes object a block of up to BLOCK ids; the last one is filled up with the table's first symbol."""
        if self.places is None:  # symbols are a vocabulary's: a place for each number up to the largest
            self.places = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 0, np.int32)
            self.places[self.symbols] = np.arange(len(self.symbols), dtype=np.int32)
        blocks = -(-len(ids) // BLOCK)
        place = np.zeros(blocks * BLOCK, np.int32)
        place[: len(ids)] = self.places[ids]
        place = place.reshape(blocks, STEPS, LANES)
        out = []
        for first in range(0, blocks, AT_ONCE):
            some = place[first : first + AT_ONCE]
            state = np.full((len(some), LANES), LOW, U64)
            words, sent = np.zeros(some.shape, np.uint32), np.zeros(some.shape, bool)
            for t in range(STEPS - 1, -1, -1):
                f, c = self.wide[some[:, t]], self.cum[some[:, t]]
                full = state >= f << U64(63 - BITS)
                words[:, t], sent[:, t] = state, full
                state = np.where(full, state >> U64(32), state)
                state += state // f * (U64(1 << BITS) - f) + c  # quotient << BITS, and the remainder
            out += [state[b].astype("<u8").tobytes() + words[b][sent[b]].astype("<u4").tobytes() for b in range(len(some))]
        return out

    def decode(self, blocks: list[bytes]) -> np.ndarray:
        """blocks x BLOCK symbols."""
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)
        out = np.empty((len(blocks), STEPS, LANES), np.uint32)
        for first in range(0, len(blocks), AT_ONCE):
            some = blocks[first : first + AT_ONCE]
            state = np.stack([np.frombuffer(b, "<u8", LANES) for b in some]).astype(U64)
            bodies = [np.frombuffer(b, "<u4", offset=8 * LANES) for b in some]
            at = np.cumsum([0] + [len(b) for b in bodies[:-1]])[:, None]
            words = np.concatenate([*bodies, np.zeros(1, np.uint32)]).astype(U64)
            for t in range(STEPS):
                slot = state & U64((1 << BITS) - 1)
                place = self.slots[slot.view(np.int64)]
                out[first : first + len(some), t] = place
                state = self.wide[place] * (state >> U64(BITS)) + slot - self.cum[place]
                need = state < LOW
                ahead = np.cumsum(need, axis=1)
                take = words[np.minimum(at + ahead - 1, len(words) - 1)]
                state = np.where(need, (state << U64(32)) | take, state)
                at = at + ahead[:, -1:]
        return self.symbols[out.reshape(len(blocks), BLOCK)]


def write_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, first: int, coder: Coder) -> bytes:
    blocks = coder.encode(ids)
    sizes = np.array([len(b) // 4 for b in blocks], np.uint64)
    counts = np.full(len(blocks), BLOCK, np.uint32)
    if len(blocks):
        counts[-1] = len(ids) - BLOCK * (len(blocks) - 1)
    head = io.BytesIO()
    for x in (
        np.array([0 if i is None else i for i in doc_ids], "<i8"), np.array([i is None for i in doc_ids], np.uint8), lengths.astype("<u4"),
        np.array([len(coder.symbols)], "<u8"), coder.symbols.astype("<u4"), coder.freq.astype("<u4"),
        (np.cumsum(sizes) - sizes).astype("<u8"), counts.astype("<u4"), np.array([zlib.crc32(b) for b in blocks], "<u4"),
    ):
        head.write(x.tobytes())
    packed = zlib.compress(head.getvalue(), 1)
    return b"".join([MAGIC, struct.pack("<5Q", len(doc_ids), len(ids), first, len(blocks), len(packed)), packed, struct.pack("<I", zlib.crc32(packed)), *blocks])


class TokenFile:
    """A file opened from its bytes. ``tokens(lo, hi)`` decodes only the blocks that hold these ids."""

    def __init__(self, raw: bytes, coder: Coder | None = None):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        docs, self.n, self.first, blocks, size = struct.unpack_from("<5Q", raw, 8)
        packed = raw[48 : 48 + size]
        if zlib.crc32(packed) != struct.unpack_from("<I", raw, 48 + size)[0]:
            raise ValueError("header checksum")
        head, at = zlib.decompress(packed), 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(head, kind, n, at)
            at += x.nbytes
            return x

        ids, null, self.lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        symbols = int(take("<u8", 1)[0])
        symbols, freq = take("<u4", symbols), take("<u4", symbols)
        same = coder is not None and np.array_equal(coder.symbols, symbols) and np.array_equal(coder.freq, freq)
        self.coder = coder if same else Coder(symbols, freq)
        self.starts, self.counts, self.sums = take("<u8", blocks).astype(np.int64), take("<u4", blocks), take("<u4", blocks)
        self.body = memoryview(raw)[52 + size :]

    def block(self, k: int) -> bytes:
        end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.body) // 4
        raw = bytes(self.body[4 * self.starts[k] : 4 * end])
        if zlib.crc32(raw) != self.sums[k]:
            raise ValueError(f"checksum of block {k}")
        return raw

    def tokens(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = self.n if hi is None else hi
        if lo >= hi:
            return np.zeros(0, np.uint32)
        first, last = lo // BLOCK, (hi - 1) // BLOCK
        flat = self.coder.decode([self.block(k) for k in range(first, last + 1)]).reshape(-1)
        return flat[lo - first * BLOCK : hi - first * BLOCK]


def write_token_files(docs: DataFrame, path: str, cut: str = "spaces", end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = 1 << 22) -> str:
    """Write every document's ids and ``end_id`` in ascending id order (nulls first, ties by text) and return the folder.

    Documents are range-partitioned by id and tokenized once; a run of documents of some ``file_ids`` ids becomes a file
    named by its place, written under another name first, so a repeated task leaves one whole file. Frequencies are
    counted over all ids. Null text is empty; repeated ids and rows are documents of their own; an empty table gives an
    empty folder; other columns aren't read, whatever their names. The folder must be one that pyarrow can write from every executor, as the default, the shared one."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/lectern/token-files-{uuid.uuid4().hex}"
    tie = F.xxhash64(text_col)
    ordered = docs.select(id_col, text_col).repartitionByRange(F.col(id_col).asc_nulls_first(), tie).sortWithinPartitions(F.col(id_col).asc_nulls_first(), tie)
    table = durable(token_table(ordered, id_col, text_col, path, cut, end_id), "file-ids")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for wide in set(b.column("wide").to_pylist()):  # one count for all documents of a batch
                raw = b.column("ids").filter(pc.equal(b.column("wide"), wide)).to_pylist()
                some = np.bincount(unpack(b"".join(raw), wide))
                total = np.pad(total, (0, max(0, len(some) - len(total))))
                total[: len(some)] += some
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["symbol", "n"])

    counts = table.select("ids", "wide").mapInArrow(tidy(histogram), "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()  # the vocabulary at most
    counts = np.array(sorted((r.symbol, r.n) for r in counts), np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((part_bases(table), counts[:, 0], frequency_table(counts[:, 0], counts[:, 1]) if len(counts) else np.zeros(0, np.uint32)))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as stores

        bases, symbols, freq = shared.value
        coder, (store, root), rows, held = Coder(symbols, freq), stores.FileSystem.from_uri(folder), [], 0
        store.create_dir(root, recursive=True)

        def flush() -> str:
            part, before = rows[0][:2]
            raw = write_file([r[2] for r in rows], np.array([len(r[3]) for r in rows]), np.concatenate([r[3] for r in rows]), bases[part] + before, coder)
            name = f"{root}/part-{part:06d}-{before:015d}.rans"
            with store.open_output_stream(other := f"{root}/.{uuid.uuid4().hex}") as out:
                out.write(raw)
            store.move(other, name)
            return name

        for b in batches:
            names = []
            for i, raw, part, before, wide in zip(*(b.column(c).to_pylist() for c in (id_col, "ids", "part", "before", "wide")), strict=True):
                if rows and (held >= file_ids or part != rows[-1][0] or before != rows[-1][1] + len(rows[-1][3])):
                    names.append(flush())
                    rows, held = [], 0
                rows.append((part, before, i, unpack(raw, wide)))
                held += len(rows[-1][3])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([flush()], pa.string())], names=["file"])

    table.mapInArrow(tidy(files), "file string").agg(F.count("file")).first()
    return folder


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of all files of a folder; ids as little-endian unsigned 32-bit bytes. A block whose
    checksum fails raises. A folder without files gives no row."""
    fields = f"`{id_col}` long, start long, n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for b in batches:
            for raw in b.column("content").to_pylist():
                f = TokenFile(raw, coder)
                coder, ids = f.coder, f.tokens().astype("<u4")
                ends = np.cumsum(f.lengths, dtype=np.int64)
                for lo in range(0, len(f.lengths), 1024):
                    some = slice(lo, lo + 1024)
                    out = [ids[e - n : e].tobytes() for e, n in zip(ends[some], f.lengths[some].astype(np.int64), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids[some], pa.int64()), pa.array(f.first + ends[some] - f.lengths[some]), pa.array(f.lengths[some].astype(np.int64)), pa.array(out, pa.binary())], names=[id_col, "start", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rans").load(folder)
    return files.select("content").mapInArrow(tidy(run), fields)
