"""SimHash of near copies: majority bits of five-word shingles, wide enough for a Jaccard of 0.8.

Sets of shingles with a Jaccard of 0.8 differ in some 15 % of their majority bits, so 64 bits and a split into blocks of
which all but a few agree don't find them. The fingerprint here has ``BLOCKS`` blocks of ``BITS`` bits and ``CHECK`` more.
As in ``simhash``, close pairs share a block, pairs meet on blocks and their Hamming distance is verified: that of the
``CHECK`` bits, which no block holds, is at most ``DISTANCE``. What passes is judged by the exact Jaccard of the sets (of
32-bit hashes). A pair at 0.8 shares a block with a probability of 0.9995, at 0.82 of 0.9999, and differs there in 19 bits
on average, 40 being five deviations up.

Equal sets collapse to one before anything meets. Rows of a block are compared inside a task, which gives out no pairs but
the groups that hold together by close fingerprints (``_near``): the work grows with the square of the sets over 2^BITS,
some 2 ns a comparison, so tables of over some 100 million sets want more bits and blocks. Of a group, each member meets
one centre (a row a member), which links most of a group of near copies; only members of groups that still hold different
components are then compared in blocks of at most ``group`` rows, inside a task, which gives out a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, durable
from .components import components, forest
from .hashing import mix
from .workers import tidy

SLICE_BYTES = 1 << 20
SLACK = 1e-6
BITS, BLOCKS = 14, 72
CHECK, DISTANCE = 128, 40
#: Sets of four and five shingles that differ in one agree on 81 % of the bits only: sets up to this size have as many
#: blocks again, of the same bits dealt in another way.
SMALL = 5
#: One 64-bit hash of a shingle for each 64 bits of the fingerprint: products with these, mixed.
ODD = mix(np.arange(-(-(CHECK + BITS * BLOCKS) // 64), dtype=np.uint64), 17) | np.uint64(1)
#: Runs of more rows than this are compared row by row with all others, shorter ones together with the runs around.
RUN = 32
#: Bits of the filter by which texts of candidates are read again; what passes it wrongly goes in a join.
FILTER_BITS = 1 << 25


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, and all hashes: each text's distinct shingles, ascending."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    rows, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    rows, flat = rows[real.to_numpy(zero_copy_only=False)], flat.filter(real)
    n = len(texts)
    counts = np.bincount(rows, minlength=n)
    first = np.concatenate(([0], np.cumsum(counts)))
    coded = flat.dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    word = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in names), np.uint64, len(names))[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)
    # a shingle starts at each word but the last ones of a document; a shorter document is one shingle
    left = counts[rows] - (np.arange(len(rows)) - first[rows])
    at = np.flatnonzero((left >= words) | ((left == counts[rows]) & (counts[rows] < words)))
    h = np.full(len(at), 42, np.uint64)
    for k in range(words):
        inside = left[at] > k
        h[inside] = _mixed(h[inside] * np.uint64(0x9E3779B97F4A7C15) + word[at[inside] + k])
    owner, h = rows[at], h.view(np.int64)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return np.bincount(owner[new], minlength=n), h[new]


def _majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The fingerprints (flags, sets x bits) of sets of ``n`` hashes in a row: a bit is set where over half of them have it."""
    out = np.empty((len(n), 64 * len(ODD)), bool)
    for row, (end, size) in enumerate(zip(np.cumsum(n).tolist(), n.tolist(), strict=True)):
        ones = np.zeros(out.shape[1], np.int64)
        for lo in range(end - size, end, 255):  # as many as a byte counts
            x = h[lo : min(lo + 255, end), None].view(np.uint64) * ODD
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
            ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
        out[row] = 2 * ones > size
    return out


def _split(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints' blocks (int32, sets x 2 BLOCKS, the block's number above its bits; the second half is for small sets)
    and check bits (int64, sets x 2)."""
    bits, powers = flags[:, CHECK : CHECK + BITS * BLOCKS], 1 << np.arange(BITS, dtype=np.int32)
    blocks = np.concatenate([bits.reshape(-1, BLOCKS, BITS) @ powers, powers @ bits.reshape(-1, BITS, BLOCKS)], axis=1)
    return (blocks + (np.arange(2 * BLOCKS) << BITS)).astype(np.int32), np.packbits(flags[:, :CHECK], axis=1).view(np.int64)


def _slices(text: pa.Array) -> Iterator[tuple[slice, pa.Array]]:
    piece = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)) // SLICE_BYTES
    for lo, hi in zip(first := np.flatnonzero(np.diff(piece, prepend=-1)), [*first[1:], len(piece)]):
        yield slice(lo, hi), pa.concat_arrays([text.slice(lo, hi - lo)])  # some string kernels misread arrays with an offset


def _sig(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    ends = np.cumsum(n)
    return np.array([xxhash.xxh3_64_intdigest(h[s:e].tobytes()) for s, e in zip(ends - n, ends)], np.uint64).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, sig, n, blocks, c0, c1): a hash of the set of ``words``-word shingles, its size, its fingerprint's blocks (none
    of an empty set) and check bits. Words are those of ``simhash.fingerprints``; fewer than ``words`` are one shingle, none
    an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, text in _slices(b.column(text_col)):
                n, h = _sets(text, words)
                blocks, check = _split(_majority(h, n))
                has = (n > 0)[:, None] & ((n <= SMALL)[:, None] | (np.arange(2 * BLOCKS) < BLOCKS))
                offsets = np.concatenate(([0], np.cumsum(has.sum(1)))).astype(np.int32)
                blocks = pa.ListArray.from_arrays(pa.array(offsets), pa.array(blocks[has]))
                ids = b.column(id_col).slice(at.start, at.stop - at.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(_sig(h, n)), pa.array(n.astype(np.int32)), blocks, pa.array(check[:, 0].copy()), pa.array(check[:, 1].copy())], names=[id_col, "sig", "n", "blocks", "c0", "c1"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, sig long, n int, blocks array<int>, c0 long, c1 long")


def _together(check: np.ndarray) -> np.ndarray:
    """Of a run's check bits (uint64, rows x 2), the smallest row that each one holds together with."""

    def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(check[x, None, 0] ^ check[None, y, 0]) + np.bitwise_count(check[x, None, 1] ^ check[None, y, 1]) <= DISTANCE

    label, left = np.arange(len(check)), np.arange(len(check))
    while len(left):
        some = left[: max(1, min(64, (1 << 20) // len(left)))]
        alone = close(some, left).sum(1) == 1
        left = left[~np.isin(left, some[alone])]
        for first in some[~alone]:
            if label[first] != first or not (left == first).any():
                continue
            left, reached = left[left != first], np.array([first])
            while len(reached) and len(left):
                wide = max(1, min(64, (1 << 20) // len(left)))
                near = close(reached[:wide], left).any(0)
                label[left[near]] = first
                reached, left = np.concatenate([reached[wide:], left[near]]), left[~near]
    return label


def _labels(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Of whole runs of equal keys, the smallest row that each one holds together with."""
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    size = np.diff(np.append(first, len(key)))
    label, end = np.arange(len(key)), np.repeat(first + size, size)
    for lo, m in zip(first[size > RUN].tolist(), size[size > RUN].tolist()):
        label[lo : lo + m] = lo + _together(check[lo : lo + m])
    at, pairs = np.flatnonzero(np.repeat(size <= RUN, size)), []
    for step in range(1, RUN):
        at = at[at + step < end[at]]
        if not len(at):
            break
        apart = np.bitwise_count(check[at] ^ check[at + step]).sum(1)
        near = at[apart <= DISTANCE]
        pairs.append(np.stack([near, near + step]))
    x, y = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    while len(x):
        lower = np.minimum(label[x], label[y])
        if (lower == np.maximum(label[x], label[y])).all():
            break
        np.minimum.at(label, x, lower)
        np.minimum.at(label, y, lower)
    return label


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sig, n): rows in order of their block, to groups of two or more that hold together by fingerprints at most
    ``DISTANCE`` bits apart; key is a hash of the group's members."""

    def groups(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        t = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        label = _labels(t["key"], np.stack([t["c0"], t["c1"]], axis=1).view(np.uint64))
        more = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
        more = more[np.argsort(label[more], kind="stable")]
        label, sig = label[more], t["sig"][more]
        new = np.flatnonzero(np.diff(label, prepend=-1))
        name = np.add.reduceat(mix(sig.view(np.uint64), 1), new) if len(new) else np.zeros(0, np.uint64)
        name = np.repeat(name, np.diff(np.append(new, len(label)))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(sig), pa.array(t["n"][more])], names=["key", "sig", "n"])

    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = {c: b.column(c).to_numpy() for c in ("key", "sig", "n", "c0", "c1")}
        last = np.searchsorted(t["key"], t["key"][-1])  # the last run may go on in the next batch
        if last or (held and held[0]["key"][0] != t["key"][0]):
            yield groups([*held, {c: v[:last] for c, v in t.items()}])
            held = []
        held.append({c: v[last:] for c, v in t.items()})
    if held:
        yield groups(held)


def shingle_sets(docs: DataFrame, text_col: str, words: int, only: tuple[str, np.ndarray] | None = None) -> DataFrame:
    """(sig, keys): each text's set as distinct 32-bit hashes. ``only``: an id column and a filter by ``_marked``; the
    texts of its ids are taken, and a few more. One map filters and hashes: two in a row would take two Python workers a
    task, and those of all later stages live on beside each other."""
    columns = [F.col(text_col)]
    if only is not None:
        columns.append(F.pmod(F.xxhash64(only[0]), F.lit(FILTER_BITS)).alias("__bit"))
        shared = docs.sparkSession.sparkContext.broadcast(only[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0)
            if only is not None:
                at = b.column(1).to_numpy()
                texts = texts.filter(pa.array((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
            for _, text in _slices(texts):
                n, h = _sets(text, words)
                low, owner = (h.view(np.uint64) >> np.uint64(32)).astype(np.uint32), np.repeat(np.arange(len(n)), n)
                both = np.unique((owner.astype(np.uint64) << np.uint64(32)) | low)
                sizes = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(n))
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(both.astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(_sig(h, n)), keys], names=["sig", "keys"])

    return docs.select(*columns).mapInArrow(tidy(run), "sig long, keys array<int>")


def _marked(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size that all of ``ids`` (id) pass, so that no text is shuffled to find theirs."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(F.shiftright(bit, 5).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}) & 31 as int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return table


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) of sets whose Jaccard is at least ``least``. A member (b) has a few pairs, a centre many:
    members' sets are joined first, so that a centre's set is never sent along with each of its pairs."""
    a, b = (sets.select(F.col("sig").alias(c), F.col("keys").alias(f"keys_{c}")).hint("merge") for c in "ab")
    both = F.size(F.array_intersect("keys_a", "keys_b"))
    return pairs.join(b, "b").join(a, "a").where(both / (F.size("keys_a") + F.size("keys_b") - both) >= least).select("a", "b")


def _close(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Which of the sets (distinct 32-bit hashes) have a Jaccard of at least ``least``: a square of flags."""
    n = np.array([len(s) for s in sets], np.int64)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner, both = np.repeat(np.arange(len(n)), n), np.zeros((len(n), len(n)), np.float32)
    wide = max(1, (4 << 20) // len(n))
    for first in range(0, len(values), wide):
        here = (place >= first) & (place < first + wide) if len(values) > wide else slice(None)
        flags = np.zeros((len(n), min(wide, len(values) - first)), np.float32)
        flags[owner[here], place[here] - first] = 1
        both += flags @ flags.T
    both = both.astype(np.float64)
    return both / np.maximum(n[:, None] + n[None, :] - both, 1) >= least


def _compared(least: float):
    """Links of rows in runs of the same (key, lo, hi), as a forest a run; a run is at most two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            sig, root, block = (t.column(c).to_numpy() for c in ("sig", "root", "block"))
            close = np.zeros((0, 0), bool)
            if (root != root[0]).any():
                flat = t.column("keys").combine_chunks()
                flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
                sets = np.split(flat.flatten().to_numpy(), np.cumsum(flat.value_lengths().to_numpy())[:-1])
                close = np.triu(_close(sets, least), 1) & (root[:, None] != root[None, :])
                if t.column("lo")[0] != t.column("hi")[0]:  # two blocks: rows of one block meet elsewhere
                    close &= block[:, None] != block[None, :]
            x, y = np.nonzero(close)
            tree = np.array(forest(sig[x], sig[y]), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(tree[:, 0]), pa.array(tree[:, 1])], names=["a", "b"])

        held, name = [], None
        for b in batches:
            names = np.rec.fromarrays([b.column(c).to_numpy() for c in ("key", "lo", "hi")])
            firsts = np.concatenate(([0], np.flatnonzero(names[1:] != names[:-1]) + 1)) if b.num_rows else []
            for lo, hi in zip(firsts, [*firsts[1:], b.num_rows]):
                if held and names[lo].tolist() != name:
                    yield links(held)
                    held = []
                held.append(b.slice(lo, hi - lo))
                name = names[lo].tolist()
        if held:
            yield links(held)

    return run


def _blocks(live: DataFrame, sets: DataFrame, least: float, group: int) -> DataFrame:
    """Links (a, b) that connect all members of a key whose Jaccard is at least ``least`` and whose roots differ. A key's
    rows are dealt into blocks of some ``group``; each two blocks of a key meet in a task of their own."""
    parts = live.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("parts"))
    rows = live.select("key", "sig", "root").join(parts.hint("merge"), "key").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "sig", "root").join(sets.hint("merge"), "sig")
    return rows.select("key", "lo", "hi", "block", "sig", "root", "keys").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(tidy(_compared(least)), "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, group: int = 512) -> DataFrame:
    """(id, component_id): one row a document; component_id is the smallest id reachable by links of documents whose
    shingles' Jaccard is at least ``least``, itself included. Null ids are left out of the minimum (null if there is no
    other). Texts without a word are copies of each other; repeated rows stay; an empty table gives no row; other columns
    aren't read, whatever their names. ``group`` bounds the rows that a task compares, not what is compared."""
    marks = durable(signatures(docs, id_col, text_col, words), "near-marks")
    distinct = durable(marks.groupBy("sig").agg(F.min(id_col).alias("first"), *[F.first(c).alias(c) for c in ("n", "blocks", "c0", "c1")]), "near-distinct")
    first = distinct.select("sig", "first")
    # different sets of so few shingles can't be close enough
    large = distinct.where(F.col("n") * (1 - least) >= least - SLACK)
    keyed = large.select(F.explode("blocks").alias("key"), "sig", "n", "c0", "c1").repartition("key").sortWithinPartitions("key")
    met = durable(keyed.mapInArrow(tidy(_near), "key long, sig long, n int").distinct(), "near-met")
    wanted = durable(met.select("sig").distinct(), "near-wanted")
    marked = _marked(first.join(wanted.hint("merge"), "sig").select(F.col("first").alias("id")))
    sets = durable(shingle_sets(docs, text_col, words, only=(id_col, marked)).join(wanted.hint("merge"), "sig", "left_semi").groupBy("sig").agg(F.first("keys").alias("keys")), "near-sets")
    discard(wanted)

    live, groups = met.withColumn("root", F.col("sig")), None
    links, turn, most = None, 0, None
    while True:
        # a member of a key meets its centre, another one each turn; not where they are linked already
        centre = live.groupBy("key").agg(F.min_by(F.struct("sig", "n", "root"), F.xxhash64("sig", F.lit(turn))).alias("c"))
        pairs = live.join(centre.hint("merge"), "key").where(f"root <> c.root AND least(n, c.n) >= {least} * greatest(n, c.n) - {SLACK}")
        pairs = durable(pairs.select(F.col("c.sig").alias("a"), F.col("sig").alias("b")).distinct(), "near-pairs")
        links = durable(_verified(pairs, sets, least), "near-links")
        found, tried = links.count(), pairs.count()
        groups = _grown(groups, links)
        live = _apart(met, groups)
        most = live.groupBy("key").count().agg(F.max("count")).first()[0]
        discard(pairs, links)
        turn += 1
        # groups that fit in a block are compared there; larger ones go on while centres link a good part of them
        if most is None or most <= group or found * 20 < tried:
            break
    if most is not None:
        links = durable(_blocks(live, sets, least, group), "near-links")
        groups = _grown(groups, links)
    named = groups.join(first.withColumnRenamed("sig", "node").hint("merge"), "node").groupBy("root").agg(F.min("first").alias("component_id")).join(groups.hint("merge"), "root").select(F.col("node").alias("sig"), "component_id")
    firsts = durable(first.join(named.hint("merge"), "sig", "left").select("sig", F.coalesce("component_id", "first").alias("component_id")), "near-firsts")
    return marks.select(id_col, "sig").join(firsts.hint("merge"), "sig").select(id_col, "component_id")


def _grown(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of all linked sets, by the groups so far and new links."""
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if groups is not None:
        edges = edges.unionByName(groups.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    return durable(components(edges), "near-groups")


def _apart(met: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the keys whose members are in different components, with these."""
    rooted = met.join(groups.withColumnRenamed("node", "sig").hint("merge"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    rooted = durable(rooted, "near-rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return durable(rooted.join(mixed.hint("merge"), "key", "left_semi"), "near-apart")
