"""Full-text search: fields, document frequencies, BM25, scores and diversity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import durable

K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 5.0, "keywords": 3.0, "abstract": 2.0, "fulltext": 1.0}
SCORE_WEIGHTS = {"relevance": 40.0, "influence": 30.0, "recency": 15.0, "evidence": 10.0, "bridge": 5.0}


def papers(documents: DataFrame) -> DataFrame:
    """Documents as papers: title (first line), tags, year, the fields of search and pages of 20 lines."""
    lines = F.split("text", "\n")
    pages = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.size(lines) / 20).cast("int"))), lambda p: F.array_join(F.slice(lines, (p - 1) * 20 + 1, F.lit(20)), "\n"))
    return documents.select(
        "doc_id", lines[0].alias("title"), F.array("lang", "source").alias("tags"), (2000 + F.col("doc_id") % 25).cast("int").alias("year"), "text", pages.alias("pages"),
    )


def search_fields(docs: DataFrame) -> dict[str, Column]:
    return {"title": T.tokens(F.col("title")), "keywords": T.tokens(F.array_join("tags", " ")), "abstract": T.tokens(F.left(F.col("pages")[0], F.lit(3000))), "fulltext": T.tokens(F.array_join("pages", " "))}


def prefilter(docs: DataFrame, tag: str | None = None, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """Tag and year bounds, each only if given; a null year fails either bound."""
    if tag:
        docs = docs.where(F.array_contains("tags", tag))
    if year_from:
        docs = docs.where(F.col("year") >= year_from)
    if year_to:
        docs = docs.where(F.col("year") <= year_to)
    return docs


def _equals(term: str):
    return lambda x: x == F.lit(term)


def term_statistics(docs: DataFrame, terms: Sequence[str], fields: Sequence[str] = tuple(FIELD_WEIGHTS), id_col: str = "doc_id") -> DataFrame:
    """(id, len_<field>, tf_<field>_<k>) for the query's terms: one pass over texts, no exploded tokens."""
    exprs = search_fields(docs)
    slim = docs.select(id_col, *[exprs[f].alias(f) for f in fields])
    out = [F.col(id_col)]
    for f in fields:
        out.append(F.size(f).cast("long").alias(f"len_{f}"))
        out += [F.size(F.filter(f, _equals(t))).cast("long").alias(f"tf_{f}_{k}") for k, t in enumerate(terms)]
    return slim.select(*out)


def bm25(docs: DataFrame, query: str, weights: Mapping[str, float] = FIELD_WEIGHTS, id_col: str = "doc_id") -> DataFrame:
    """(id, bm25) of documents that score over 0: for each distinct query token and field weight * idf * tf * 2.2 over
    tf + 1.2 (0.25 + 0.75 length / average length). Corpus statistics are one aggregate row, joined by broadcast."""
    spark = docs.sparkSession
    terms = list(dict.fromkeys(spark.range(1).select(T.tokens(F.lit(query)).alias("t")).first().t))
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("bm25")).where("false")
    fields = [f for f, w in weights.items()]
    stats = durable(term_statistics(docs, terms, fields, id_col), "term-statistics")  # texts are tokenized once
    has = [sum((F.col(f"tf_{f}_{k}") for f in fields), F.lit(0)) > 0 for k in range(len(terms))]
    corpus = stats.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"len_{f}").alias(f"avg_{f}") for f in fields], *[F.count_if(h).alias(f"df_{k}") for k, h in enumerate(has)])
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df_{k}") + 0.5) / (F.col(f"df_{k}") + 0.5))
        for f in fields:
            mean = F.coalesce(F.nullif(F.col(f"avg_{f}"), F.lit(0.0)), F.lit(1.0))
            tf = F.col(f"tf_{f}_{k}")
            score = score + weights[f] * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"len_{f}") / mean))
    return stats.crossJoin(F.broadcast(corpus)).select(id_col, score.alias("bm25")).where("bm25 > 0")


def snippets(docs: DataFrame, terms: Sequence[str], most: int = 3, id_col: str = "doc_id") -> DataFrame:
    """The pages with most distinct query terms (ties by page), and text around the first one. The place is that in the
    normalised text, applied to the page as it is."""
    pages = docs.select(id_col, F.posexplode("pages").alias("page", "body"))
    found = T.tokens(F.col("body"))
    hits = sum((F.array_contains(found, t).cast("int") for t in terms), F.lit(0))
    at = [F.instr(T.normalize(F.col("body")), F.lit(t)) for t in terms]
    first = F.coalesce(F.array_min(F.filter(F.array(*at), lambda x: x > 0)) - 1, F.lit(0))
    rows = pages.select(id_col, (F.col("page") + 1).alias("page"), hits.alias("hits"), F.substring(F.col("body"), F.greatest(F.lit(0), first - 120) + 1, first + 600 - F.greatest(F.lit(0), first - 120)).alias("snippet")).where("hits > 0")
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("hits"), "page"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def candidates(found: DataFrame, docs: DataFrame, most: int = 50, id_col: str = "doc_id") -> DataFrame:
    """(id, score): the ``most`` best rows of ``found`` (id, score; ties by id). Where nothing was found, the first
    ``most`` of ``docs`` (id, ord) instead, with scores that fall from 1 by an equal step. Both are top-k reports."""
    top = found.select(id_col, "score").orderBy(F.desc("score"), id_col).limit(most)
    first = docs.select(id_col, "ord").orderBy("ord", id_col).limit(most)
    place = F.row_number().over(Window.orderBy("ord", id_col)) - 1  # over ``most`` rows
    rest = first.select(id_col, (1 - place / most).alias("score")).join(top.limit(1).select(F.lit(1).alias("__hit")), F.lit(True), "left_anti")
    return top.unionByName(rest)


def evidence(found: DataFrame, docs: DataFrame, terms: Sequence[str], results: int = 6, each: int = 2, most: int = 8, id_col: str = "doc_id") -> DataFrame:
    """(place, id, title, page, hits, snippet): the sources of an answer. ``each`` snippets of the ``results`` best rows
    of ``found`` (id, score; ties by id), in this order the first ``most``; of no result none."""
    best = found.select(id_col, "score").orderBy(F.desc("score"), id_col).limit(results)
    texts = docs.join(F.broadcast(best.select(id_col)), id_col, "left_semi")  # ``results`` ids
    rows = snippets(texts, terms, each, id_col).join(texts.select(id_col, "title"), id_col).join(best, id_col)
    place = F.row_number().over(Window.orderBy(F.desc("score"), id_col, "rank"))  # over results * each rows
    return rows.withColumn("place", place).where(F.col("place") <= most).select("place", id_col, "title", "page", "hits", "snippet")


def recency(year: Column, as_of: int, half_life: float = 5.0) -> Column:
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(F.lit(0), as_of - year) / (half_life or 5.0)), F.lit(0.0))


def recency_edge(year: Column, as_of: int) -> Column:
    return 0.7 + 0.3 * F.exp(-F.greatest(F.lit(0), as_of - F.coalesce(year, F.lit(as_of))) / 8)


def recency_node(year: Column, as_of: int) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0), as_of - year) / 20), F.lit(0.5))


def linear_score(relevance: Column, influence: Column, frontier: Column, evidence: Column, bridge: Column) -> Column:
    return 0.4 * relevance + 0.3 * influence + 0.15 * frontier + 0.1 * evidence + 0.05 * bridge


def hybrid_score(features: Mapping[str, Column], weights: Mapping[str, float] = SCORE_WEIGHTS) -> Column:
    """Weighted mean of features; weights that are all 0 fall back to the defaults."""
    weights = {**SCORE_WEIGHTS, **weights}
    if not any(weights.values()):
        weights = SCORE_WEIGHTS
    total = sum(weights.values()) or 1.0
    return sum((c * (weights[k] / total) for k, c in features.items()), F.lit(0.0))


def role(frontier: Column, influence: Column) -> Column:
    return F.when(frontier > 0.85, "frontier").when(influence > 0.8, "hub").otherwise("foundation")


def mmr(candidates: DataFrame, count: int, penalty: float, scale: float = 1.0, limit: int | None = None) -> DataFrame:
    """Greedy diversity over (id, score, terms): ``count`` times the row with the largest scale * score - penalty * its
    largest Jaccard with those chosen; ties keep score order, then id. Only the chosen rows' terms (``count`` at most)
    are known to the driver; each step is one top-1 over the candidates."""
    from pyspark.sql import types as PT

    rows = candidates.select("id", "score", "terms")
    if limit:
        rows = rows.orderBy(F.desc("score"), "id").limit(limit)
    rows = rows.cache()
    chosen: list = []
    try:
        while len(chosen) < count:
            worst = F.lit(0.0)
            for c in chosen:
                theirs = F.lit(c.terms) if c.terms else F.array().cast("array<string>")
                union = F.size(F.array_union("terms", theirs))
                worst = F.greatest(worst, F.when(union > 0, F.size(F.array_intersect("terms", theirs)) / union).otherwise(0.0))
            left = rows.where(~F.col("id").isin([c.id for c in chosen])) if chosen else rows
            best = left.withColumn("value", scale * F.col("score") - penalty * worst).orderBy(F.desc("value"), F.desc("score"), "id").first()
            if best is None:
                break
            chosen.append(best)
    finally:
        rows.unpersist()
    schema = PT.StructType([PT.StructField("rank", PT.IntegerType()), candidates.schema["id"], PT.StructField("score", PT.DoubleType()), PT.StructField("value", PT.DoubleType())])
    return candidates.sparkSession.createDataFrame([(k + 1, c.id, float(c.score), float(c.value)) for k, c in enumerate(chosen)], schema)
