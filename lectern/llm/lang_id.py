"""Language ID by a string kernel: blended-spectrum n-gram presence, Nystroem landmarks, one-versus-rest kernel ridge.

The kernel of two texts is the number of 1-, 2- and 3-grams that both hold, over the root of the product of their own
numbers (so 1 for equal sets). N-grams are of symbols: blank for all but letters, a-z after lower-casing, and
``OTHERS`` classes that other letters are hashed to; that bounds a text's presence row at ``SPECTRUM`` flags whatever its
length. Training takes at most ``per_label`` rows a label and ``max_rows`` in all, picked by a hash of the id; the
driver gets their presence rows as packed bits (7.6 kB a row). Scoring is a matrix product for each batch of texts:
presence rows times landmarks times weights, the last two multiplied out once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workers import tidy

OTHERS = 12
S = 27 + OTHERS
SPECTRUM = S**3 + S**2 + S
BATCH, BATCH_CHARS = 48, 1 << 20
UNKNOWN = "und"


@cache
def _symbols() -> np.ndarray:
    """Every code point's symbol."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()[0]
            out[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) * 2654435761 >> 12) % OTHERS
    return out


def _slices(texts: list[str]) -> Iterator[list[str]]:
    some, chars = [], 0
    for t in texts:
        if some and (len(some) == BATCH or chars + len(t) > BATCH_CHARS):
            yield some
            some, chars = [], 0
        some.append(t)
        chars += len(t)
    if some:
        yield some


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flags (texts x SPECTRUM) and whether each text has a letter. Two blanks stand before and after a text."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(r) + 4 for r in raw], np.int64)
    s = np.zeros(int(sizes.sum()) + 2, np.int32)
    ends = np.cumsum(sizes)
    table, letters = _symbols(), np.zeros(len(texts), bool)
    for k, r in enumerate(raw):
        s[ends[k] - sizes[k] + 2 : ends[k] - 2] = part = table[r]
        letters[k] = part.any()
    base = np.repeat(np.arange(len(texts), dtype=np.int64) * SPECTRUM, sizes)
    flags = np.zeros(len(texts) * SPECTRUM, np.uint8)
    a, b, c = s[:-2], s[1:-1], s[2:]
    two = a * S + b
    flags[base + two * S + c] = 1
    flags[base + S**3 + two] = 1
    flags[base + S**3 + S**2 + a] = 1
    return flags.reshape(len(texts), SPECTRUM), letters


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray  # SPECTRUM x labels
    bias: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for some in _slices(texts):
            flags, letters = presence(some)
            if not self.labels:
                names += [UNKNOWN] * len(some)
                scores += [0.0] * len(some)
                continue
            margins = flags.astype(np.float32) @ self.weights / np.sqrt(flags.sum(1, dtype=np.int64))[:, None] + self.bias
            best = margins.argmax(1)
            names += [self.labels[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
            scores += [float(x) if ok else 0.0 for x, ok in zip(np.clip((margins.max(1) + 1) / 2, 0, 1).astype(float), letters, strict=True)]
        return names, scores

    def predict(self, docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
        """The columns ``keep`` (all) of ``docs`` with lang_pred and score (replaced if there). Null text or text without
        a letter: ``und``, 0. Rows in, rows out; names of other columns don't matter."""
        keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
        own = text_col not in keep
        shared = docs.sparkSession.sparkContext.broadcast(self)  # SPECTRUM x labels floats

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names, scores = shared.value.score(pc.fill_null(b.column(text_col), "").to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

        schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
        return docs.select(*keep, *([text_col] if own else [])).mapInArrow(tidy(run), schema)


def _solve(bits: np.ndarray, target: np.ndarray, labels: int, landmarks: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Kernel ridge regression on Nystroem features; bits: packed presence rows, target: their label numbers."""

    def rows(at: np.ndarray) -> np.ndarray:
        x = np.unpackbits(bits[at], axis=1, count=SPECTRUM).astype(np.float32)
        return x / np.sqrt(x.sum(1, keepdims=True))

    turn = np.empty(len(target), np.int64)  # how many of its label stand before a row
    for k in range(labels):
        turn[target == k] = np.arange((target == k).sum())
    marks = np.lexsort((target, turn))[:landmarks]  # one of each label in turn
    z = rows(marks)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    ok = values > 1e-6 * values[-1]
    root = vectors[:, ok] / np.sqrt(values[ok])
    phi = np.concatenate([rows(np.arange(k, min(k + 128, len(bits)))) @ z.T for k in range(0, len(bits), 128)]).astype(np.float64) @ root
    y = np.where(target[:, None] == np.arange(labels), 1.0, -1.0)
    each = 1 / np.bincount(target, minlength=labels)[target]  # labels weigh the same
    each *= len(each) / each.sum()
    mean, middle = np.average(phi, axis=0, weights=each), np.average(y, axis=0, weights=each)
    centred = (phi - mean) * each[:, None]
    w = np.linalg.solve(centred.T @ (phi - mean) + ridge * len(phi) * np.eye(phi.shape[1]), centred.T @ (y - middle))
    return (z.T @ (root @ w)).astype(np.float32), (middle - mean @ w).astype(np.float32)


def fit(docs: DataFrame, trainable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 300, max_rows: int = 2400, landmarks: int = 256, ridge: float = 1e-4, max_labels: int = 1000) -> LanguageModel:
    """Learn from the rows with a label and text where ``trainable`` holds: a sample of at most ``per_label`` a label,
    ``max_rows`` in all, but two a label at least. Without such a row the model has no labels (it predicts ``und``), as
    from an empty table. More than ``max_labels`` labels raise ValueError: the weights and the sample, both a share a
    label, are held by the driver. Null labels and texts, and texts without a letter, teach nothing; repeated rows and
    null ids count like others; other columns aren't read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("y"), F.xxhash64(F.col(id_col)).alias("h"), (F.lit(True) if trainable is None else trainable).alias("ok"))
    rows = rows.where("ok and y is not null")
    counts = rows.groupBy("y").count().limit(max_labels + 1).collect()
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    if not counts:
        return LanguageModel([], np.zeros((SPECTRUM, 0), np.float32), np.zeros(0, np.float32))
    each = max(2, min(per_label, max_rows // len(counts)))
    # a share of the hashes that holds some more rows than asked for, for each label; then the smallest hashes of these
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.y, min(1.0, (each + 4 * each**0.5 + 8) / r["count"]))])
    picked = rows.where(F.pmod("h", F.lit(1 << 40)) < F.element_at(share, F.col("y")) * float(1 << 40)).where("t is not null")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, letters = [], []
            for some in _slices(b.column("t").to_pylist()):
                flags, ok = presence(some)
                bits += [x.tobytes() for x in np.packbits(flags, axis=1)]
                letters += ok.tolist()
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), pa.array(bits, pa.binary()), pa.array(letters)], names=["h", "y", "bits", "ok"])

    packed = picked.select("h", "y", "t").mapInArrow(tidy(pack), "h long, y string, bits binary, ok boolean").where("ok")
    # the smallest hashes of each label: the picked rows of a label are few, whatever it has in all
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.pmod("h", F.lit(1 << 40)), "h", "bits"))
    sample = packed.withColumn("rank", rank).where(F.col("rank") <= each).collect()  # 7.6 kB a row
    sample.sort(key=lambda r: (r.h % (1 << 40), r.h, r.y, r.bits))
    kept, have = [], {}
    for r in sample:
        if have.setdefault(r.y, 0) < each:
            have[r.y] += 1
            kept.append(r)
    if not kept:
        return LanguageModel([], np.zeros((SPECTRUM, 0), np.float32), np.zeros(0, np.float32))
    labels = sorted(have)
    target = np.array([labels.index(r.y) for r in kept])
    weights, bias = _solve(np.stack([np.frombuffer(r.bits, np.uint8) for r in kept]), target, len(labels), landmarks, ridge)
    return LanguageModel(labels, weights, bias)


def held_out(id_col: str = "doc_id") -> Column:
    """The CRC-32 of the id as text leaves 2 when divided by 4 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
