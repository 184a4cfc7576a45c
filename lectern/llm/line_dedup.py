"""Line dedup: a sharded minimal perfect hash over frequent line keys; documents probe its arrays.

Pass 1 turns each document into the 128-bit hashes of its distinct keys and counts their documents: rows of a key and
an id meet first, spread by both, then the keys' partial counts (a hot line is one row a task). Keys below ``min_docs`` go. Pass 2 builds, per shard of keys, a minimal
perfect hash that indexes fingerprint, count and keeper arrays. Pass 3 streams the documents past the arrays: they are
broadcast in rounds of at most ``round_bytes`` (one round up to about 3 million frequent lines), each round dropping
the lines of its shards, so memory is bounded at every size and no line is joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable
from .hashing import PerfectHash, mix
from .workers import tidy

BLANKS = " \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 16
NO_ID = -(1 << 63)


def _lines(text: pa.Array) -> tuple[pa.ListArray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text; for every line its row, both key hashes (0, 0 where the key is too short to count)."""
    lists = pc.split_pattern(pc.fill_null(text.cast(pa.large_string()), ""), "\n")
    rows = pc.list_parent_indices(lists).to_numpy()
    return lists, rows, pc.list_flatten(lists)


def _keys(lines: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = pc.ascii_trim(pc.ascii_lower(lines), characters=BLANKS)
    long = pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False)
    digests = b"".join(xxhash.xxh3_128_digest(k) for k in keys.filter(pa.array(long)).cast(pa.large_binary()).to_pylist())
    h = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
    return long, h[:, 0], h[:, 1]


def _count(id_col: str, text_col: str, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, rows, lines = _lines(b.column(text_col))
            long, h1, h2 = _keys(lines, min_chars)
            if not len(h1):
                continue
            seen = np.unique(np.rec.fromarrays([rows[long], h1, h2], names="r,a,b"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen.a.view(np.int64)), pa.array(seen.b.view(np.int64)), pc.fill_null(b.column(id_col).cast(pa.int64()), NO_ID).take(pa.array(seen.r))], names=["h1", "h2", "id"]
            )

    return run


def _slot_keys(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of both hashes, others for each seed."""
    return h1 ^ mix(h2, seed)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = (pdf[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    # keys differ in h1 or h2; the mixture of two may be the same under one seed, so the first that tells all apart is taken
    seed, key = next((s, k) for s in range(64) if len(np.unique(k := _slot_keys(h1, h2, s))) == len(k))
    phf = PerfectHash.build(key)
    at = np.empty(len(key), np.int64)
    at[phf.index(key)] = np.arange(len(key))
    cols = {"fingerprints": pdf.h2.to_numpy(), "counts": np.minimum(pdf.n.to_numpy(), 2**32 - 1).astype(np.uint32), "keepers": pdf["keep"].to_numpy()}
    return pd.DataFrame([{"shard": int(pdf.shard.iloc[0]), "seed": seed, "sizes": phf.sizes.tobytes(), "words": phf.words.tobytes()} | {k: v[at].tobytes() for k, v in cols.items()}])


class LineIndex:
    """The arrays of some shards, as bytes; opened on first use in a worker."""

    def __init__(self, shards: int, rows: list):
        self.shards, self.raw, self.open = shards, {r.shard: r for r in rows}, {}

    def __getstate__(self):
        return {"shards": self.shards, "raw": self.raw, "open": {}}

    def _shard(self, k: int):
        if k not in self.open:
            r = self.raw[k]
            phf = PerfectHash(np.frombuffer(r.sizes, np.int64), np.frombuffer(r.words, np.uint64))
            self.open[k] = int(r.seed), phf, np.frombuffer(r.fingerprints, np.uint64), np.frombuffer(r.counts, np.uint32), np.frombuffer(r.keepers, np.int64)
        return self.open[k]

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold each key (0: not frequent) and the id that keeps it."""
        n, keep = np.zeros(len(h1), np.uint32), np.full(len(h1), NO_ID, np.int64)
        shard = h1.view(np.int64) % self.shards
        for k in np.unique(shard):
            if int(k) not in self.raw:
                continue
            at = np.flatnonzero(shard == k)
            seed, phf, fp, counts, keepers = self._shard(int(k))
            slot = phf.index(_slot_keys(h1[at], h2[at], seed))
            ok = (slot >= 0) & (fp[np.maximum(slot, 0)] == h2[at])
            n[at[ok]], keep[at[ok]] = counts[slot[ok]], keepers[slot[ok]]
        return n, keep


def _drop(id_col: str, text_col: str, min_chars: int, index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = index.value
        for b in batches:
            lists, rows, lines = _lines(b.column(text_col))
            long, h1, h2 = _keys(lines, min_chars)
            n, keep = arrays.probe(h1, h2)
            ids = pc.fill_null(b.column(id_col).cast(pa.int64()), NO_ID).to_numpy()
            gone = np.zeros(len(rows), bool)
            gone[long] = (n > 0) & (keep != ids[rows[long]])
            stay = np.flatnonzero(~gone)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(rows[stay], minlength=b.num_rows)))).astype(np.int64)
            kept = pa.LargeListArray.from_arrays(pa.array(offsets), lines.take(pa.array(stay)))
            text = pc.binary_join(kept, pa.scalar("\n", pa.large_string())).cast(pa.string())
            dropped = np.bincount(rows[gone], minlength=b.num_rows).astype(np.int64)
            made = {text_col: text, "__n_lines": pa.array(np.bincount(rows, minlength=b.num_rows).astype(np.int64)), "__n_dropped": pa.array(dropped)}
            names = b.schema.names
            if "__n_dropped" in names:  # a later round: the first one counted the lines
                made |= {"__n_lines": b.column("__n_lines"), "__n_dropped": pc.add(b.column("__n_dropped"), made["__n_dropped"])}
            names = [*names, *(x for x in made if x not in names)]
            yield pa.RecordBatch.from_arrays([made[x] if x in made else b.column(x) for x in names], names=names)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, round_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with ``text_col`` cut to its kept lines, plus ``n_lines`` and ``n_dropped`` (replaced if there already).

    A line's key is the line without blanks at its ends and with A-Z lower-cased. Keys of at least ``min_chars`` code
    points held by at least ``min_docs`` documents (different ids; rows of one id are one document, those without an id
    too) lose all their lines except in the largest ``id_col`` holding them. A null or empty text is one empty line and
    comes back as ''. A null id counts as smaller than any other. Repeated rows of the largest id all keep the line. Other columns pass through whatever their names; an empty table stays empty.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "__n_lines", "__n_dropped")
    hashed = docs.select(id_col, text_col).mapInArrow(tidy(_count(id_col, text_col, min_chars)), "h1 long, h2 long, id long")
    frequent = hashed.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs)
    frequent = durable(frequent, "frequent-lines")
    total = frequent.count()
    shards = max(1, -(-total // SHARD_KEYS))
    sharded = frequent.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("long"))
    arrays = durable(sharded.groupBy("shard").applyInPandas(_build, "shard long, seed int, sizes binary, words binary, fingerprints binary, counts binary, keepers binary"), "line-arrays")
    per_round = max(1, round_bytes // (21 * SHARD_KEYS))  # 8 + 4 + 8 bytes a key and under 1 of hash
    out_schema = T.StructType([T.StructField(f.name, f.dataType if f.name != text_col else T.StringType()) for f in docs.schema] + [T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())])
    rounds = range(0, shards, per_round)
    out = docs
    for first in rounds:
        rows = arrays.where((F.col("shard") >= first) & (F.col("shard") < first + per_round)).collect()  # bounded by round_bytes
        index = spark.sparkContext.broadcast(LineIndex(shards, rows))
        out = out.mapInArrow(tidy(_drop(id_col, text_col, min_chars, index)), out_schema)
        if first != rounds[-1]:
            out = durable(out, "line-round")
    return out.withColumnsRenamed({"__n_lines": "n_lines", "__n_dropped": "n_dropped"})


def sha256_hex(col: str):
    return F.sha2(F.encode(F.col(col), "UTF-8"), 256)


def brute_force(rows: list[tuple[int | None, str | None]], min_docs: int = 3, min_chars: int = 20) -> list[tuple]:
    """The same by dictionaries, for tests: (id, n_lines, n_dropped, sha256)."""
    lower = {c: c + 32 for c in range(65, 91)}
    split = [(i, (t or "").split("\n")) for i, t in rows]
    holders: dict[str, set] = {}
    for i, lines in split:
        for key in {x.strip(BLANKS).translate(lower) for x in lines}:
            holders.setdefault(key, set()).add(NO_ID if i is None else i)
    out = []
    for i, lines in split:
        kept = []
        for x in lines:
            ids = holders[key := x.strip(BLANKS).translate(lower)]
            if len(key) < min_chars or len(ids) < min_docs or max(ids) == (NO_ID if i is None else i):
                kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out
