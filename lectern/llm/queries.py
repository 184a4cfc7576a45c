"""The registered queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from ..sources.tables import table
from . import embed_dedup, html_text, lang_id, line_dedup, media, mixing, packing, quality, simhash, token_file
from .tokens import tokenizer_path


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs, trainable=~lang_id.held_out())
    return model.predict(docs, keep=["doc_id"]).select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", line_dedup.sha256_hex("text").alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    length = (F.octet_length("ids") / 4).cast("long").alias("length")
    return pieces.select("doc_id", "start", length, F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.default_levels(), mixing.DEFAULT_WEIGHTS, fraction=0.6)
    return mixed.select("doc_id", "epoch", "domain", "lang", "source", "n_tokens")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_file.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_file.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = durable(media.text_media(table(spark, sf_dir, "documents")), "media")
    seen = media.decode_media(stored)
    size = F.octet_length("pixels").cast("long")
    return seen.select(
        "doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("dhash").alias("feature"), F.sha2("tile", 256).alias("tile_sha256"),
    )


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.extract_pages(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_packing, op4_simhash, op5_mixing, op6_token_file, op7_media, op8_html, op9_quality, op10_embedding_dedup)}

ORACLE_SQL = {
    "op2_line_dedup": """
        WITH lines AS (
            SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
        ), often AS (
            SELECT k, max(coalesce(doc_id, -9223372036854775808)) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 3
        ), flagged AS (
            SELECT l.*, o.k IS NOT NULL AND o.keeper <> coalesce(l.doc_id, -9223372036854775808) AS gone FROM lines l LEFT JOIN often o ON l.k = o.k
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM flagged GROUP BY doc_id
    """,
    "op5_mixing": """
        WITH docs AS (
            SELECT doc_id, 'd' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4) AS d, coalesce(lang, '') AS l, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents
        ), leaf AS (
            SELECT d, l, s, sum(n) AS n, 2.0::DOUBLE * sum(n) AS cap, CASE d WHEN 'd0' THEN 0.4 WHEN 'd1' THEN 0.3 WHEN 'd2' THEN 0.2 ELSE 0.1 END::DOUBLE AS w1, CASE l WHEN 'en' THEN 0.4 ELSE 0.2 END::DOUBLE AS w2, 1.0::DOUBLE AS w3 FROM docs GROUP BY d, l, s
        ), level1 AS (
            SELECT d, least(cap, w * coalesce(arg_min(lam, cap / w) FILTER (WHERE cap / w > lam) OVER (), 1e300)) AS amount FROM (
                SELECT *, ((SELECT 0.6 * sum(n) FROM leaf) - coalesce(sum(cap) OVER (ORDER BY cap / w, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM (SELECT d, sum(cap) AS cap, any_value(w1) AS w FROM leaf GROUP BY d) b) c),
        level2 AS (
            SELECT d, l, least(cap, w * coalesce(arg_min(lam, cap / w) FILTER (WHERE cap / w > lam) OVER (PARTITION BY d ), 1e300)) AS amount FROM (
                SELECT *, (up - coalesce(sum(cap) OVER (PARTITION BY d ORDER BY cap / w, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY d ORDER BY cap / w, l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM (SELECT x.d, x.l, x.cap, x.w, u.amount AS up FROM (SELECT d, l, sum(cap) AS cap, any_value(w2) AS w FROM leaf GROUP BY d, l) x JOIN level1 u ON x.d = u.d) b) c),
        level3 AS (
            SELECT d, l, s, least(cap, w * coalesce(arg_min(lam, cap / w) FILTER (WHERE cap / w > lam) OVER (PARTITION BY d, l ), 1e300)) AS amount FROM (
                SELECT *, (up - coalesce(sum(cap) OVER (PARTITION BY d, l ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY d, l ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM (SELECT x.d, x.l, x.s, x.cap, x.w, u.amount AS up FROM (SELECT d, l, s, sum(cap) AS cap, any_value(w3) AS w FROM leaf GROUP BY d, l, s) x JOIN level2 u ON x.d = u.d AND x.l = u.l) b) c),
        plan AS (SELECT d, l, s, b // n AS whole, b % n AS rest FROM (SELECT d, l, s, CAST(n AS BIGINT) AS n, least(CAST(floor(amount + 1e-6) AS BIGINT), CAST(2 * n AS BIGINT)) AS b FROM leaf JOIN level3 USING (d, l, s)) q),
        prefix AS (SELECT docs.*, whole, rest, sum(docs.n) OVER (PARTITION BY d, l, s ORDER BY md5('42|' || whole || '|' || doc_id) ROWS UNBOUNDED PRECEDING) AS run FROM docs JOIN plan USING (d, l, s))
        SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, d AS domain, l AS lang, s AS source, CAST(n AS BIGINT) AS n_tokens FROM (
            SELECT doc_id, d, l, s, n, unnest(range(whole)) AS epoch FROM prefix UNION ALL SELECT doc_id, d, l, s, n, whole FROM prefix WHERE rest > 0 AND run <= rest) r
    """,
    "op10_embedding_dedup": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
            WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.95
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM vectors UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT r.a AS vec_id, coalesce(max(c.n), 0) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept
        FROM reach r LEFT JOIN counts c ON r.a = c.a GROUP BY r.a
    """,
}
