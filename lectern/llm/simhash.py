"""SimHash near-dedup: pigeonhole blocks. Fingerprints are split into blocks; a pair within the distance agrees on all
blocks but as many as the distance, so pairs meet on combinations of blocks and their Hamming distance is verified.

Copies collapse to one fingerprint before anything meets. A block group of up to ``group`` fingerprints emits its
verified pairs; larger ones go another, exact way: each fingerprint meets the smallest one at each half-distance
neighbour value, a partially aggregated minimum that emits no pairs, however large the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .components import components
from .workers import tidy

SLICE_BYTES = 1 << 20


def _fingerprints(texts: pa.Array, words: int) -> np.ndarray:
    """The 64-bit majority fingerprint of each text's word shingles."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    rows, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    rows, flat = rows[real.to_numpy(zero_copy_only=False)], flat.filter(real)
    n = len(texts)
    counts = np.bincount(rows, minlength=n)
    first = np.concatenate(([0], np.cumsum(counts)))
    # a shingle starts at each word but the last ones of a document; a shorter document is one shingle
    left = counts[rows] - (np.arange(len(rows)) - first[rows])
    at = np.flatnonzero(left >= words)
    parts = [flat.take(pa.array(at + k)) for k in range(words)]
    shingles = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).to_pylist() if len(at) else []
    owner = rows[at]
    for i in np.flatnonzero((counts > 0) & (counts < words)):
        shingles.append(" ".join(flat.slice(first[i], counts[i]).to_pylist()).encode())
        owner = np.append(owner, i)
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
    order = np.argsort(owner, kind="stable")
    owner, h = owner[order], h[order]
    total = np.bincount(owner, minlength=n)
    starts = np.cumsum(total) - total
    some = np.flatnonzero(total)
    out = np.zeros(n, np.uint64)
    if len(some):
        ones = np.empty((64, len(some)), np.int64)
        for bit in range(64):
            ones[bit] = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), starts[some])
        for bit in range(64):
            out[some] |= (2 * ones[bit] > total[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, out: str = "fp") -> DataFrame:
    """(id, fp): A-Z lower-cased texts' words (between ASCII blanks), ``words``-word shingles joined by spaces, repeats
    included, hashed by XXH64 seed 42; a bit is set where over half of the hashes have it. Fewer words: one shingle of all;
    none or null: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(text_col)
            size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
            piece, fps = np.cumsum(size) // SLICE_BYTES, []
            for k in np.unique(piece):
                where = np.flatnonzero(piece == k)
                fps.append(_fingerprints(pa.concat_arrays([text.slice(where[0], len(where))]), words))  # some string kernels misread arrays with an offset
            fp = np.concatenate(fps).view(np.int64) if fps else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(fp)], names=[id_col, out])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{out}` long")


def close_pairs(fps: DataFrame, distance: int = 2, blocks: int = 5, group: int = 48) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints (column fp, distinct) within ``distance`` bits into components;
    ``distance`` is 2 or less where groups exceed ``group``."""
    if distance not in (1, 2):
        raise ValueError("distance is 1 or 2")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    keys = [sum(m) for m in combinations(masks, blocks - distance)]
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "block"))
    sizes = durable(keyed.groupBy("mask", "block").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "simhash-sizes")  # so that the join can split a large group
    met = durable(keyed.join(sizes, ["mask", "block"]), "simhash-groups")
    small = met.where(F.col("size") <= group)
    pairs = small.alias("x").join(small.alias("y"), ["mask", "block"]).where("x.fp < y.fp and bit_count(x.fp ^ y.fp) <= " + str(distance)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    # Within a large group: values at most one bit from both of two fingerprints exist exactly where these are within
    # two bits, and all that share such a value are within two bits of each other.
    bits = [(1 << k) - (1 << 64) if k == 63 else 1 << k for k in range(64)]
    large = met.where(F.col("size") > group).select("fp").distinct()
    if distance == 2:
        near = F.explode(F.array(F.lit(0), *[F.lit(x) for x in bits]))
        spread = large.select("fp", near.alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("value"))
    else:  # a pair one bit apart shares the value with that bit cleared, and the bit
        spread = large.select("fp", F.explode(F.array(*[F.struct(F.lit(x).alias("bit"), F.col("fp").bitwiseAND(F.lit(~x)).alias("rest")) for x in bits])).alias("value"))
    stars = spread.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a < last").select("value", "a")
    starred = spread.join(stars, "value").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2, blocks: int = 5, group: int = 48) -> DataFrame:
    """(id, fp, component_id): one row a document; component_id is the smallest id reachable by links of fingerprints
    within ``distance`` bits, itself included. Null ids are left out of the minimum (null if there is no other). Texts without a word have fingerprint 0 and link like
    any other; repeated rows stay; an empty table stays empty."""
    fp = durable(fingerprints(docs, id_col, text_col, words), "simhash")
    distinct = fp.groupBy("fp").agg(F.min(id_col).alias("first"))
    distinct = durable(distinct, "simhash-distinct")
    links = close_pairs(distinct.select("fp"), distance, blocks, group)
    groups = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))  # node, root: linked fingerprints only
    named = groups.join(distinct.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("first").alias("component_id")).join(groups, "root").select(F.col("node").alias("fp"), "component_id")
    firsts = durable(distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "simhash-firsts")
    return fp.join(firsts, "fp").select(id_col, "fp", "component_id")
