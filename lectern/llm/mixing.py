"""Mixing sources to target weights: hierarchical budgets over a tree of columns, then seeded token-prefixes of leaves.

Budgets flow from the root down. A node never gets more than its leaves can give in ``max_epochs`` epochs; what a node
cannot take goes to its siblings in proportion to their weights, and only what no sibling takes goes up. A leaf's budget
is whole epochs of all its documents and a prefix of one more: documents in the order of MD5(seed|epoch|id) as long as
their running tokens stay within what is left.

The prefix needs no global sort: documents' keys (the MD5 and a hash of the text) are cut into ranges by their first
letters, token totals of the 256 ranges say which one holds the border, and that one is cut again by the next letters;
only what few rows are left in the last border range are sorted by a window. All this is on a narrow table of leaves,
ids and sizes: texts are read once more at the end, by a map that compares each row's key with its leaf's border. All
work on rows is built-in functions; the driver sees one row a leaf (at most ``max_leaves``), not documents.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, durable

WORD = "[^\\x20\\x09-\\x0D]+"
BROADCAST_LEAVES = 20_000
#: Ranges of keys are cut by ``STEP`` letters at a time, until the largest border range has so many rows or its key ends.
STEP, SORTED_ROWS = 2, 1024
MD5_LETTERS, KEY_LETTERS = 32, 48


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def share_out(budget: float, nodes: Sequence[tuple[float, float]]) -> list[float]:
    """Split ``budget`` among (weight, capacity) nodes in proportion to weight, none over its capacity, what one cannot
    take going to the others; nodes without weight get something only when all others are full."""
    out = [0.0] * len(nodes)
    for some in ([i for i, n in enumerate(nodes) if n[0] > 0], [i for i, n in enumerate(nodes) if n[0] <= 0]):
        weight = {i: nodes[i][0] if nodes[i][0] > 0 else 1.0 for i in some}
        order = sorted(some, key=lambda i: (nodes[i][1] / weight[i], i))
        left, heavy = budget - sum(out), sum(weight.values())
        for i in order:
            out[i] = min(nodes[i][1], max(0.0, left) * weight[i] / heavy) if heavy > 0 else 0.0
            left, heavy = left - out[i], heavy - weight[i]
    return out


def leaf_budgets(leaves: Sequence[tuple[tuple[str, ...], int]], budget: float, weights: Sequence[Mapping[str, float]], default: float, max_epochs: int) -> dict[tuple[str, ...], int]:
    """Whole tokens of each leaf. ``leaves``: path and tokens; ``weights``: for each level, of values (others: default)."""

    def down(some: list[tuple[tuple[str, ...], int]], level: int, amount: float) -> dict[tuple[str, ...], int]:
        if level == len(weights):
            (path, tokens), = some
            return {path: min(math.floor(amount + 1e-6), tokens * max_epochs)}
        groups: dict[str, list] = {}
        for leaf in sorted(some):
            groups.setdefault(leaf[0][level], []).append(leaf)
        parts = share_out(amount, [(weights[level].get(k, default), float(max_epochs * sum(t for _, t in g))) for k, g in groups.items()])
        out: dict[tuple[str, ...], int] = {}
        for (_, g), part in zip(groups.items(), parts, strict=True):
            out |= down(g, level + 1, part)
        return out

    return down(list(leaves), 0, budget) if leaves else {}


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Sequence[Mapping[str, float]], fraction: float | None = None, budget: int | None = None, max_epochs: int = 2, seed: int = 42, default: float = 1.0, id_col: str = "doc_id", text_col: str = "text", max_leaves: int = 1_000_000) -> DataFrame:
    """The chosen rows of ``docs``, one for each epoch that a row is in, with ``epoch`` (0, 1, ...), ``n_tokens`` (words)
    and the levels' names as columns (replacing such columns). The target is ``budget`` tokens or ``fraction`` of all.

    A null level value is the empty string, a null text has no word, a null id counts as an empty one. Repeated rows and
    ids are rows of their own, ties go by a 64-bit hash of the text; of equal rows at the border as many are taken as
    fit. Documents without a word cost nothing and stand in the order like others; a leaf of such documents only is in
    every epoch. An empty table stays empty. Texts are read twice, whole, and never sorted or shuffled (up to
    ``BROADCAST_LEAVES`` leaves; beyond, rows meet their leaf's border in a shuffled join)."""
    names = list(levels)
    made = [*names, "n_tokens", "epoch"]
    paths = [F.coalesce(levels[n].cast("string"), F.lit("")).alias(f"__mix_{n}") for n in names]
    path_cols = [f"__mix_{n}" for n in names]
    identity = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    base = docs.select("*", *paths, identity.alias("__mix_id"), count_words(F.col(text_col)).alias("__mix_n"))
    slim = durable(base.select(*path_cols, "__mix_id", F.hex(F.xxhash64(F.col(text_col))).alias("__mix_tie"), "__mix_n"), "mix-sizes")
    stats = slim.groupBy(*path_cols).agg(F.sum("__mix_n").alias("n")).limit(max_leaves + 1).collect()
    if len(stats) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    leaves = [(tuple(r)[:-1], r.n) for r in stats]
    target = float(budget if budget is not None else sum(n for _, n in leaves) * (1.0 if fraction is None else fraction))
    budgets = leaf_budgets(leaves, target, weights, default, max_epochs)
    plan = [(*path, (b := budgets[path]) // n if n else max_epochs, b % n if n else 0) for path, n in leaves]
    spark = docs.sparkSession
    # as an Arrow table: rows of a list would take Python workers of their own, which live on beside the others
    kinds = {c: pa.string() for c in path_cols} | {"__mix_full": pa.int32(), "__mix_rest": pa.int64()}
    plan_df = spark.createDataFrame(pa.table({c: pa.array([row[k] for row in plan], kind) for k, (c, kind) in enumerate(kinds.items())}))
    hint = F.broadcast if len(plan) <= BROADCAST_LEAVES else (lambda x: x)  # a leaf is under 1 kB, so under 20 MB

    def key(tie: Column) -> Column:
        return F.concat(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__mix_full").cast("string"), F.col("__mix_id"))), F.lpad(tie, 16, "0"))

    border = plan_df.where("__mix_rest > 0").select(*path_cols, "__mix_full", "__mix_rest", F.lit("").alias("__mix_range"), F.lit(0).cast("long").alias("__mix_before"))
    while True:
        old, border = border, durable(_border(_inside(slim, border, path_cols, key(F.col("__mix_tie")), hint), path_cols), "mix-borders")
        discard(old)
        if border.where((F.col("__mix_rows") > SORTED_ROWS) & (F.length("__mix_range") < KEY_LETTERS)).isEmpty():
            break
    # The first key past the prefix, and how many of the rows that share it (same id, same text) fit in still.
    last = _inside(slim, border, path_cols, key(F.col("__mix_tie")), hint).groupBy(*path_cols, "__mix_rest", "__mix_before", "__mix_key").agg(F.sum("__mix_n").alias("n"), F.count(F.lit(1)).alias("rows"))
    running = last.withColumn("end", F.col("__mix_before") + F.sum("n").over(Window.partitionBy(*path_cols).orderBy("__mix_key"))).where("end > __mix_rest")
    first = running.groupBy(*path_cols).agg(F.min(F.struct("__mix_key", F.expr("(__mix_rest - (end - n)) div (n div rows)").alias("take"))).alias("b"))
    bounds = durable(plan_df.join(hint(first), path_cols, "left").select(*path_cols, "__mix_full", F.col("b.__mix_key").alias("__mix_bound"), F.coalesce("b.take", F.lit(0)).alias("__mix_take")), "mix-bounds")
    discard(border)
    rows = base.join(hint(bounds), path_cols).withColumn("__mix_key", key(F.hex(F.xxhash64(F.col(text_col)))))
    whole = F.when(F.col("__mix_full") > 0, F.sequence(F.lit(0), F.col("__mix_full") - 1)).otherwise(F.array().cast("array<int>"))
    one_more = F.when(F.col("__mix_key") < F.col("__mix_bound"), F.array("__mix_full")).otherwise(F.array().cast("array<int>"))
    keep = [c for c in docs.columns if c not in made]
    cols = [*(F.col(f"`{c}`") for c in keep), *(F.col(f"__mix_{n}").alias(n) for n in names), F.col("__mix_n").alias("n_tokens"), F.col("epoch").cast("int").alias("epoch")]
    out = rows.withColumn("epoch", F.explode(F.concat(whole, one_more))).select(*cols)
    if not bounds.where("__mix_take > 0").isEmpty():  # some of several equal rows: which ones makes no difference
        tied = rows.where("__mix_take > 0 and __mix_key = __mix_bound").withColumn("epoch", F.col("__mix_full"))
        number = F.row_number().over(Window.partitionBy(*path_cols, "__mix_key").orderBy("__mix_n"))
        out = out.unionByName(tied.withColumn("__mix_number", number).where("__mix_number <= __mix_take").select(*cols))
    return out


def _inside(slim: DataFrame, border: DataFrame, path_cols: list[str], key: Column, hint) -> DataFrame:
    """Rows of the border ranges, with their key."""
    wide = slim.join(hint(border.select(*path_cols, "__mix_full", "__mix_rest", "__mix_range", "__mix_before")), path_cols)
    return wide.withColumn("__mix_key", key).where(F.startswith("__mix_key", "__mix_range"))


def _border(narrow: DataFrame, path_cols: list[str]) -> DataFrame:
    """Each leaf's border range cut by the next letters: the part that holds the border, the tokens before it and its
    rows; a window's 256 parts a leaf at most. Where all rows of the part share one MD5, the next cut is behind it."""
    of = [*path_cols, "__mix_full", "__mix_rest", "__mix_range", "__mix_before"]
    md5 = F.substring("__mix_key", 1, MD5_LETTERS)
    cut = F.expr(f"substring(__mix_key, length(__mix_range) + 1, {STEP})")
    parts = narrow.groupBy(*of, cut.alias("cut")).agg(F.sum("__mix_n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min(md5).alias("least"), F.max(md5).alias("most"))
    parts = parts.withColumn("end", F.col("__mix_before") + F.sum("n").over(Window.partitionBy(*path_cols).orderBy("cut")))
    found = parts.where("end > __mix_rest").groupBy(*of[:-1]).agg(F.min(F.struct("cut", (F.col("end") - F.col("n")).alias("before"), "rows", "least", "most")).alias("b"))
    shorter = F.length("__mix_range") + STEP < MD5_LETTERS
    reach = F.when(shorter & (F.col("b.least") == F.col("b.most")), F.col("b.least")).otherwise(F.concat("__mix_range", "b.cut"))
    return found.select(*of[:-2], reach.alias("__mix_range"), F.col("b.before").alias("__mix_before"), F.col("b.rows").alias("__mix_rows"))


def default_levels() -> dict[str, Column]:
    """domain (of a source's number, by 4), language, source."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    return {"domain": F.concat(F.lit("d"), F.coalesce((number.try_cast("long") % 4).cast("string"), F.lit(""))), "lang": F.col("lang"), "source": F.col("source")}


DEFAULT_WEIGHTS = [{"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}, {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, {}]


def brute_force(rows: list[dict], weights, fraction: float, max_epochs: int, seed: int) -> list[tuple]:
    """Rows: id, path, n. The same choice by sorting whole leaves; (id, epoch, n), for tests."""
    import hashlib

    leaves: dict[tuple, int] = {}
    for r in rows:
        leaves[r["path"]] = leaves.get(r["path"], 0) + r["n"]
    budgets = leaf_budgets(list(leaves.items()), sum(leaves.values()) * fraction, weights, 1.0, max_epochs)
    out = []
    for path, n in leaves.items():
        some = [r for r in rows if r["path"] == path]
        full, rest = divmod(budgets[path], n) if n else (max_epochs, 0)
        out += [(r["id"], e, r["n"]) for e in range(full) for r in some]
        run = 0
        for r in sorted(some, key=lambda r: hashlib.md5(f"{seed}|{full}|{r['id']}".encode()).hexdigest()):
            run += r["n"]
            if rest and run <= rest:
                out.append((r["id"], full, r["n"]))
    return out
