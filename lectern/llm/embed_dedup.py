"""Embedding near-dedup: a small-world graph per shard, every shard queried by every vector, cosine verified in double
precision, components of the links.

Equal vectors collapse to one representative first. Shards hold about ``shard_rows`` vectors, so a graph is bounded
(some 1 kB a vector of 64 floats). Executors write each graph to a file in the shared folder, and the tasks of a block of
queries open the files there one after another; the driver knows their names only.
Before that, audits compare the beam with brute force for sampled queries against each shard, widening it until recall
is at least ``recall``. In the search itself a query whose beam comes back half full of close vectors is widened, at
last to all rows of the shard, so a large group of near copies loses no link. What a batch of queries finds leaves the
task as counts and a spanning forest, never as all pairs of a group.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, shared_dir
from .components import components, forest
from .hnsw import Hnsw
from .workers import release, tidy

SLACK = 1e-4  # float32 similarities may be off by less than this
ROUND_SHARDS = 64  # opened by a task one after another
BLOCK_ROWS = 50_000  # queries of a task
AUDIT, AUDIT_LIMIT = 128, 1024


def _unit(raw: np.ndarray) -> np.ndarray:
    x = _scaled(raw)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no cosine and keeps squares from overflow and from nothing."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = _scaled(a), _scaled(b)
    return np.einsum("nd,nd->n", a, b) / (np.sqrt(np.einsum("nd,nd->n", a, a)) * np.sqrt(np.einsum("nd,nd->n", b, b)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


class Shard:
    """A graph with its vectors' representatives, copies and double-precision components."""

    def __init__(self, rep: np.ndarray, copies: np.ndarray, raw: np.ndarray, graph: Hnsw):
        self.rep, self.copies, self.raw, self.graph = rep, copies, raw, graph

    def save(self, path: str) -> None:
        """Write the shard whole or not at all: a task that is run again leaves one file."""
        from pyarrow import fs as stores

        store, place = stores.FileSystem.from_uri(path)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        raw = io.BytesIO()
        np.savez(raw, rep=self.rep, copies=self.copies, raw=self.raw, graph=np.frombuffer(self.graph.dump(), np.uint8))
        with store.open_output_stream(other := f"{place}-{uuid.uuid4().hex}") as out:
            out.write(raw.getbuffer())
        store.move(other, place)

    @classmethod
    def load(cls, path: str) -> Shard:
        from pyarrow import fs as stores

        store, place = stores.FileSystem.from_uri(path)
        with store.open_input_file(place) as f:
            z = np.load(io.BytesIO(f.read()))
            return cls(z["rep"], z["copies"], z["raw"], Hnsw.load(z["graph"].tobytes()))

    def links(self, rep: np.ndarray, raw: np.ndarray, least: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(query numbers, nodes) whose verified cosine is at least ``least``; a query doesn't meet itself."""
        q, node = self.graph.within(_unit(raw), least - SLACK, ef)
        ok = self.rep[node] != rep[q]
        q, node = q[ok], node[ok]
        keep = np.concatenate([_cosine(raw[q[k : k + 65536]], self.raw[node[k : k + 65536]]) >= least for k in range(0, len(q), 65536)] or [np.zeros(0, bool)])
        return q[keep], node[keep]


def _build(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        raw = np.frombuffer(b"".join(pdf.raw), np.float64).reshape(len(pdf), -1)
        path = f"{folder}/{raw.shape[1]}-{int(pdf.shard.iloc[0])}.npz"
        Shard(pdf.rep.to_numpy(), pdf.copies.to_numpy(), raw, Hnsw(_unit(raw))).save(path)
        release()
        return pd.DataFrame([{"dims": raw.shape[1], "shard": int(pdf.shard.iloc[0]), "path": path}])

    return run


def _audit(least: float, queries, recall: float, widest: int):
    """For each shard, the smallest beam among 32, 64, ... whose recall for the sampled queries is ``recall``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                shard = Shard.load(row["path"])
                rep, raw = queries.value.get(row["dims"], (np.zeros(0, np.int64), np.zeros((0, row["dims"]))))
                # sampled vectors of all shards, and some of this one, to which others may be close
                step = max(1, len(shard.rep) // AUDIT_LIMIT)
                rep, raw = np.concatenate([rep, shard.rep[::step]]), np.concatenate([raw, shard.raw[::step]])
                unit, truth = _unit(raw), 0
                pairs = set()
                for lo in range(0, len(rep), 64):
                    q, node = np.nonzero(unit[lo : lo + 64] @ shard.graph.x.T >= least - SLACK)
                    q = q + lo
                    ok = (shard.rep[node] != rep[q]) & (_cosine(raw[q], shard.raw[node]) >= least)
                    pairs.update(zip(q[ok].tolist(), node[ok].tolist(), strict=True))
                truth, ef, found = len(pairs), 32, 0
                while True:
                    q, node = shard.links(rep, raw, least, ef)
                    found = len(pairs.intersection(zip(q.tolist(), node.tolist(), strict=True)))
                    if found >= recall * truth or ef >= widest:
                        break
                    ef *= 2
                out.append((ef, truth, found))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["ef", "truth", "found"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, shard_rows: int = 100_000, min_shards: int = 4, recall: float = 0.995, widest: int = 2048) -> DataFrame:
    """(id, n_links, component_id, kept), one row a vector: the other vectors within cosine ``least``, the smallest id
    reachable by links, and whether that is its own.

    Vectors that are null, empty, all zero, or hold null, NaN or infinite components link with nothing and stay, as do
    rows with a null id. Vectors of different lengths don't link. Repeated rows are vectors of their own that link with
    each other. An empty table gives no row. The shared folder must be one that pyarrow reaches from every executor."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = durable(vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False)), v).alias("v")), "vectors")
    keyed = rows.where("v is not null").select("id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))
    reps = durable(keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v")), "distinct-vectors")

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            flat, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("copies"), pa.array([flat[i:j].astype(np.float64).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["rep", "copies", "raw"])

    total = reps.count()
    shards = max(min_shards, -(-total // shard_rows))
    packed = reps.select("rep", "copies", "v").mapInArrow(tidy(as_bytes), "rep long, copies long, raw binary")
    packed = durable(packed.withColumn("dims", (F.octet_length("raw") / 8).cast("int")).withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int")), "shard-vectors")
    folder = f"{shared_dir(spark)}/lectern/graphs-{uuid.uuid4().hex}"
    graphs = durable(packed.groupBy("dims", "shard").applyInPandas(_build(folder), "dims int, shard int, path string"), "shard-graphs")

    sample: dict[int, list] = {}
    for r in packed.orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(AUDIT).collect():
        sample.setdefault(r.dims, []).append(r)
    queries = spark.sparkContext.broadcast({d: (np.array([r.rep for r in rs]), np.stack([np.frombuffer(r.raw, np.float64) for r in rs])) for d, rs in sample.items()})
    audit = graphs.repartition("dims", "shard").mapInArrow(tidy(_audit(least, queries, recall, widest)), "ef long, truth long, found long").agg(F.max("ef"), F.sum("truth"), F.sum("found")).first()
    ef, truth, found = audit[0] or 32, audit[1] or 0, audit[2] or 0
    if truth and found < 0.9 * truth:
        raise RuntimeError(f"audited recall {found / truth:.3f} with a beam of {ef}")

    def search(paths):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(b.column("rep").to_numpy(), _matrix(b.column("raw"))) for b in batches if b.num_rows]  # some BLOCK_ROWS queries
            for path in paths if held else ():
                opened = Shard.load(path)
                for reps_, raws in held:
                    for lo in range(0, len(reps_), 2048):
                        rep, raw = reps_[lo : lo + 2048], raws[lo : lo + 2048]
                        q, node = opened.links(rep, raw, least, ef)
                        n = np.bincount(q, weights=opened.copies[node], minlength=len(rep)).astype(np.int64)
                        some_n = np.flatnonzero(n)
                        tree = np.array(forest(rep[q], opened.rep[node]), np.int64).reshape(-1, 2)
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[some_n], tree[:, 0]])), pa.array(np.concatenate([np.full(len(some_n), -1), tree[:, 1]]), mask=np.arange(len(some_n) + len(tree)) < len(some_n)), pa.array(np.concatenate([n[some_n], np.zeros(len(tree), np.int64)]))], names=["src", "dst", "n"])

        return tidy(run)

    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, -(-total // BLOCK_ROWS))
    files: dict[int, list[str]] = {}
    for r in graphs.select("dims", "shard", "path").collect():  # names only
        files.setdefault(r.dims, []).append(r.path)
    found_rows = None
    for dims, paths in sorted(files.items()):
        for first in range(0, len(paths), ROUND_SHARDS):
            hits = packed.where(F.col("dims") == dims).select("rep", "raw").repartition(blocks).mapInArrow(search(sorted(paths)[first : first + ROUND_SHARDS]), "src long, dst long, n long")
            part = durable(hits, "vector-links")
            found_rows = part if found_rows is None else found_rows.unionByName(part)
    if found_rows is None:
        found_rows = spark.createDataFrame([], "src long, dst long, n long")
    linked = components(found_rows.where("dst is not null").select("src", "dst"))
    counts = found_rows.where("dst is null").groupBy("src").agg(F.sum("n").alias("n"))
    known = reps.select("k1", "k2", "rep", "copies").join(counts.withColumnRenamed("src", "rep"), "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    known = durable(known.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "vector-groups")
    out = keyed.drop("v").join(known, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
