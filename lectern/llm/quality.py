"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of characters, trained on all trusted text;
documents' perplexity against language-specific quantiles.

Symbols are code points below ``PLAIN`` and hashed classes of the others, 12 bits each, so a 5-gram is an exact 60-bit
key. Raw 5-gram counts of all trusted documents are one partially aggregated shuffle; continuation counts, contexts,
discounts and the interpolated probabilities of every order are joins of these count tables, sharded by n-gram. The
finished probabilities are cut into shards by the two symbols before the last, which a lookup and all its back-offs
share; documents are scored against them in rounds of at most ``round_entries`` (up to that many n-grams, one round), so
no count is dropped and no n-gram of a document is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .hashing import mix
from .workers import tidy

N, WIDTH, PLAIN = 5, 12, 3072
START, END = 0, 1
SLICE_CHARS = 1 << 20
U64 = np.uint64


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, each with N - 1 starts before and an end after it; lengths with these."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(r) + N for r in raw], np.int64)
    s = np.full(int(sizes.sum()), START, np.int64)
    at = 0
    for r, size in zip(raw, sizes.tolist(), strict=True):
        s[at + N - 1 : at + size - 1] = r
        at += size
    big = (s >= PLAIN) | (s == END)
    s[big] = PLAIN + (s[big] * 2654435761 >> 8) % ((1 << WIDTH) - PLAIN)
    s[np.cumsum(sizes) - 1] = END
    return s, sizes


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The N-gram ending at each symbol and at the end of each text, in order, and their number a text."""
    s, sizes = _symbols(texts)
    code = s.copy()
    for back in range(1, N):
        code[back:] |= s[:-back] << (WIDTH * back)
    first = np.cumsum(sizes) - sizes
    real = np.ones(len(s), bool)
    real[(first[:, None] + np.arange(N - 1)).ravel()] = False
    return code[real], sizes - (N - 1)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    some, chars = [], 0
    for t in texts:
        if some and chars + len(t) > SLICE_CHARS:
            yield some
            some, chars = [], 0
        some.append(t)
        chars += len(t)
    if some:
        yield some


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for some in _slices(pc.fill_null(b.column(0), "").to_pylist()):
            c, n = np.unique(_grams(some)[0], return_counts=True)
            both, where = np.unique(np.concatenate([codes, c]), return_inverse=True)
            codes, counts = both, np.bincount(where, weights=np.concatenate([counts, n])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "c"])


def _discounts(grams: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and over; 0.5, 1 and 1.5 where counts of counts are missing."""
    n = [x or 0 for x in grams.agg(*[F.sum((F.col("c") == k).cast("long")) for k in (1, 2, 3, 4)]).first()]
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.1) for k in (1, 2, 3))


def train(trusted: DataFrame, text_col: str = "text") -> DataFrame:
    """The model as a table (kind, code, value): kind k in 1..N: log-probability of a seen k-gram's last symbol; kind
    8 + k: log of the weight that the context of k symbols leaves to shorter ones."""
    base = trusted.select(text_col).mapInArrow(_count, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))
    grams = {N: durable(base, f"grams-{N}")}
    for k in range(N - 1, 0, -1):
        grams[k] = durable(grams[k + 1].groupBy(F.col("code").bitwiseAND(F.lit((1 << WIDTH * k) - 1)).alias("code")).agg(F.count(F.lit(1)).alias("c")), f"grams-{k}")
    shorter, model = None, None
    for k in range(1, N + 1):
        d1, d2, d3 = _discounts(grams[k])
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = grams[k].select("code", F.shiftright("code", WIDTH).alias("ctx"), "c", off.alias("off"))
        left = rows.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("left"))
        rows = rows.join(left, "ctx")
        if k == 1:
            p = rows.select("code", ((F.col("c") - F.col("off")) / F.col("total") + F.col("left") / float(1 << WIDTH)).alias("p"))
        else:
            low = shorter.select(F.col("code").alias("tail"), F.col("p").alias("low"))
            p = rows.withColumn("tail", F.col("code").bitwiseAND(F.lit((1 << WIDTH * (k - 1)) - 1))).join(low, "tail").select("code", ((F.col("c") - F.col("off")) / F.col("total") + F.col("left") * F.col("low")).alias("p"))
        shorter = durable(p, f"probabilities-{k}")
        part = shorter.select(F.lit(k).alias("kind"), "code", F.log("p").cast("float").alias("value")).unionByName(left.select(F.lit(8 + k - 1).alias("kind"), F.col("ctx").alias("code"), F.log("left").cast("float").alias("value")))
        model = part if model is None else model.unionByName(part)
    return durable(model, "quality-model")


class Table:
    """Open addressing over keys of kind and code: log-probabilities and back-off weights of one round."""

    def __init__(self, kind: np.ndarray, code: np.ndarray, value: np.ndarray):
        self.bits = max(4, math.ceil(math.log2(2 * len(code) + 1)))
        self.keys, self.values = np.zeros(1 << self.bits, U64), np.zeros(1 << self.bits, np.float32)
        key = (kind.astype(U64) << U64(60)) | code.astype(U64)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = key[won], value[won]
            left = left[self.keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key, 3) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, kind: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their values (0 where not)."""
        key = U64(kind << 60) | code.astype(U64)
        slot = self._slot(key)
        seen = self.keys[slot]
        hit = seen == key
        out = np.where(hit, self.values[slot], np.float32(0))
        left = np.flatnonzero(~hit & (seen != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[left]]
            ok = seen == key[left]
            hit[left[ok]], out[left[ok]] = True, self.values[slot[left[ok]]]
            left = left[~ok & (seen != 0)]
        return hit, out

    def logs(self, code: np.ndarray) -> np.ndarray:
        """Log-probability of the last symbol of each N-gram, by the longest seen one and the weights passed on the way."""
        out, left = np.zeros(len(code), np.float32), np.arange(len(code))
        for k in range(N, 0, -1):
            some = code[left] & ((1 << WIDTH * k) - 1)
            hit, value = self.find(k, some)
            out[left[hit]] += value[hit]
            left, some = left[~hit], some[~hit]
            if not len(left):
                return out
            out[left] += self.find(8 + k - 1, some >> WIDTH)[1]
        out[left] -= WIDTH * math.log(2)
        return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.column(k).to_numpy().astype(t).tobytes()], pa.binary()) for k, t in (("kind", "u1"), ("code", "i8"), ("value", "f4"))], names=["kind", "code", "value"])


def _collect(model: DataFrame) -> Table:
    """13 bytes an entry reach the driver, packed by batches."""
    rows = model.mapInArrow(_pack, "kind binary, code binary, value binary").collect()
    kind, code, value = (np.frombuffer(b"".join(bytes(r[k]) for r in rows), t) for k, t in enumerate(("u1", "i8", "f4")))
    return Table(kind, code, value)


def _round_of(code: np.ndarray, rounds: int) -> np.ndarray:
    """By the two symbols before the last."""
    return (mix(((code >> WIDTH) & ((1 << 2 * WIDTH) - 1)).astype(U64), 5) % U64(rounds)).astype(np.int64)


def _score(text_col: str, table, which: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = table.value
        for b in batches:
            sums, sizes = [], []
            for some in _slices(pc.fill_null(b.column(text_col), "").to_pylist()):
                code, n = _grams(some)
                if rounds > 1:
                    mine = np.flatnonzero(_round_of(code, rounds) == which)
                    logs = np.zeros(len(code))
                    logs[mine] = model.logs(code[mine])
                else:
                    logs = model.logs(code)
                sums.append(np.add.reduceat(logs.astype(np.float64), np.cumsum(n) - n))
                sizes.append(n)
            total, n = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((sums, np.float64), (sizes, np.int64)))
            made = {"__lp": pa.array(total if which == 0 else total + b.column("__lp").to_numpy()), "__len": pa.array(n)}
            last = which == rounds - 1
            names = [x for x in b.schema.names if x not in made and not (last and x == "__text")]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), *made.values()], names=[*names, *made])

    return run


def perplexities(docs: DataFrame, model: DataFrame, columns: dict[str, Column], text_col: str = "text", round_entries: int = 4_000_000) -> DataFrame:
    """``columns`` and perplexity of every row; null text is empty (its end alone)."""
    spark = docs.sparkSession
    entries = model.count()
    rounds = max(1, -(-entries // round_entries))
    rows = docs.select(*[c.alias(n) for n, c in columns.items()], F.col(text_col).alias("__text"))
    for which in range(rounds):
        parts = model
        if rounds > 1:  # k-grams from three symbols on and contexts from two on have the two symbols; shorter ones are in every round

            def belongs(kind, code, which=which):
                at = np.where(kind >= 8, code << WIDTH, code)
                own = np.where(kind >= 8, kind - 8 >= 2, kind >= 3)
                return ~own | (_round_of(at, rounds) == which)

            def pick(batches, belongs=belongs):
                for b in batches:
                    yield b.filter(pa.array(belongs(b.column("kind").to_numpy().astype(np.int64), b.column("code").to_numpy())))

            parts = model.mapInArrow(pick, model.schema)
        shared = spark.sparkContext.broadcast(_collect(parts))  # bounded by round_entries and the pairs of symbols
        last = which == rounds - 1
        fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("__lp", "__len") and not (last and f.name == "__text")), "__lp double", "__len long"])
        rows = rows.mapInArrow(_score("__text", shared, which, rounds), fields)
        if not last:
            rows = durable(rows, "quality-round")
    return rows.select(*columns, F.exp(-F.col("__lp") / F.col("__len")).alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, holdout: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """(id, lang, perplexity, threshold, kept), one row a document.

    Trusted are documents whose id ``labels`` (id_col, quality, toxic) has with quality 1 and not toxic. One in
    ``holdout`` of them, by the CRC-32 of the id as text, is left out of training; a language's threshold is the
    ``quantile`` of these documents' perplexities, for a language without any that of all languages' (infinite if there
    is none). A document is kept if its perplexity is at most its language's threshold. A null language is the language
    ''; a null id has no label; repeated rows are documents of their own; an empty table gives no row."""
    # labels grow with the documents: the join is by shuffle at every size
    ids = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(id_col).alias("__id")).distinct().hint("merge")
    out = F.crc32(F.col(id_col).cast("string").cast("binary")) % holdout == 0
    trusted = docs.select(id_col, text_col).where(~out).join(ids, F.col(id_col) == F.col("__id"), "left_semi")
    model = train(trusted, text_col)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    scored = durable(perplexities(docs, model, {id_col: F.col(id_col), "lang": lang}, text_col, **how), "quality-scores")
    held = scored.where(out).join(ids, F.col(id_col) == F.col("__id"), "left_semi")
    limit = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    limits = durable(held.groupBy("lang").agg(limit.alias("own")), "quality-limits")
    common = held.agg(limit).first()[0]
    threshold = F.coalesce("own", F.lit(float("inf") if common is None else common))
    return scored.join(limits, "lang", "left").select(id_col, "lang", "perplexity", threshold.alias("threshold"), (F.col("perplexity") <= threshold).alias("kept"))
