"""A training-data pipeline over ``documents``: stages of (name, function), each written and read again as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import lang_id, line_dedup, mixing, near_copies, packing
from lectern.llm.tokens import tokenizer_path
from lectern.session import durable, prepare
from lectern.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predict every document's language, learning from the documents themselves; those without a letter (null and empty
    texts among them) go, the others get the predicted language. Null ids, languages and sources and repeated rows stay;
    of equal scores the label that comes first in the alphabet wins; an empty table stays empty. Columns beyond
    ``COLUMNS`` are left behind, in this stage as in all."""
    prepare(spark)
    model = lang_id.fit(docs)
    seen = model.predict(docs, keep=list(COLUMNS)).where(F.col("lang_pred") != lang_id.UNKNOWN)
    return seen.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that repeat across documents; documents of which nothing is left go. A null id is smaller than any other,
    a null text goes, repeated rows of a line's last document all keep it; an empty table stays empty."""
    kept = line_dedup.dedup_lines(prepare(spark) and docs.select(*COLUMNS))
    return kept.where(F.length(F.trim("text")) > 0).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (met by SimHash blocks; five-word shingles, Jaccard of 0.8 or more), one stays: that with the
    smallest id (null is larger than any), of several rows with this id the one whose text has the smallest 64-bit hash,
    of rows with the same id and text the one with the smallest language, source and length, nulls first. Texts without a
    word are copies of each other; an empty table stays empty."""
    prepare(spark)
    # names a document; ids may be null or stand in several rows
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"))
    docs = docs.select(*COLUMNS, key.alias("__key"))
    groups = near_copies.near_copies(docs.select("__key", "text"), id_col="__key")
    first = durable(groups.where("__key = component_id").groupBy("__key").agg(F.count(F.lit(1)).alias("rows")), "first-of-group")
    # ids grow with the documents: the joins are by shuffle at every size
    once, again = (first.where(c).select("__key").hint("merge") for c in ("rows = 1", "rows > 1"))
    rest = [F.struct("lang", "source", "n_chars").alias("rest"), *(F.col(c) for c in ("__key", "doc_id", "text"))]
    equal = docs.join(again, "__key", "left_semi").select(*rest).groupBy("__key").agg(F.min(F.struct("rest", "doc_id", "text")).alias("x"))
    return docs.join(once, "__key", "left_semi").select(*COLUMNS).unionByName(equal.select("x.doc_id", "x.text", "x.rest.lang", "x.rest.source", "x.rest.n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources to their target weights, 80 % of the tokens there are, two epochs at most (a
    document may come twice). Null levels are the empty name, a null text has no word, null ids and ties go by a hash of
    the text, repeated rows are documents of their own; an empty table stays empty."""
    prepare(spark)
    return mixing.mix(docs, mixing.default_levels(), mixing.DEFAULT_WEIGHTS, fraction=0.8).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids as pieces of documents, in the table's order. A null text is its end id alone, null ids stay
    and repeated rows are documents of their own; an empty table has no piece."""
    prepare(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("simhash", dedup_near), ("mixing", mix_sources), ("packing", pack)]

#: Training a classifier, fingerprints and tokenizing are beyond SQL: tests/llm compares each stage with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
