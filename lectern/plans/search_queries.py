"""Queries of search, similarity and graph operators. Documents stand in for papers, orders for citation edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, search, similarity
from ..session import pieces
from .registry import Tables, query, same

QUERY = "attion ertion retion"
AS_OF = 2026

TOK = "regexp_extract_all(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '[a-z0-9]+')"
PAPERS = f"""papers AS (
    SELECT doc_id, string_split(text, chr(10))[1] AS title, lang || ' ' || source AS tags, text, CAST(2000 + doc_id % 25 AS INTEGER) AS year, array_to_string(string_split(text, chr(10))[1:20], chr(10)) AS page1 FROM documents
), fields AS (
    SELECT doc_id, {TOK.format('title')} AS title, {TOK.format('tags')} AS keywords, {TOK.format('left(page1, 3000)')} AS abstract, {TOK.format('text')} AS fulltext FROM papers
), stats AS (
    SELECT (SELECT count(*) FROM fields) AS n, * FROM (SELECT avg(len(title)) AS a1, avg(len(keywords)) AS a2, avg(len(abstract)) AS a3, avg(len(fulltext)) AS a4 FROM fields)
), terms AS (SELECT unnest(['attion', 'ertion', 'retion']) AS t
), tf AS (
    SELECT doc_id, t, len(list_filter(title, lambda x: x = t)) AS t1, len(title) AS l1, len(list_filter(keywords, lambda x: x = t)) AS t2, len(keywords) AS l2,
        len(list_filter(abstract, lambda x: x = t)) AS t3, len(abstract) AS l3, len(list_filter(fulltext, lambda x: x = t)) AS t4, len(fulltext) AS l4 FROM fields, terms
), df AS (SELECT t, count(*) FILTER (WHERE t1 + t2 + t3 + t4 > 0) AS df FROM tf GROUP BY t
), bm AS (
    SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * (5.0 * t1 / (t1 + 1.2 * (0.25 + 0.75 * l1 / a1)) + 3.0 * t2 / (t2 + 1.2 * (0.25 + 0.75 * l2 / a2)) + 2.0 * t3 / (t3 + 1.2 * (0.25 + 0.75 * l3 / a3)) + 1.0 * t4 / (t4 + 1.2 * (0.25 + 0.75 * l4 / a4)))) AS bm25
    FROM tf JOIN df USING (t), stats GROUP BY doc_id HAVING sum(t1 + t2 + t3 + t4) > 0
)"""


def papers(t: Tables) -> DataFrame:
    return search.papers(t.documents)


@query("a01_average_lengths", f"WITH {PAPERS} SELECT round(a1, 6) AS title, round(a2, 6) AS keywords, round(a3, 6) AS abstract, round(a4, 6) AS fulltext FROM stats")
def a01(t: Tables):
    stats = search.term_statistics(papers(t), [])
    return stats.agg(*[F.round(F.coalesce(F.nullif(F.avg(f"len_{f}"), F.lit(0.0)), F.lit(1.0)), 6).alias(f) for f in search.FIELD_WEIGHTS])


@query("a02_df", f"WITH {PAPERS} SELECT t AS term, df FROM df")
def a02(t: Tables):
    terms = QUERY.split()
    stats = search.term_statistics(papers(t), terms)
    counts = stats.agg(*[F.count_if(sum((F.col(f"tf_{f}_{k}") for f in search.FIELD_WEIGHTS), F.lit(0)) > 0).alias(x) for k, x in enumerate(terms)])
    return counts.unpivot([], terms, "term", "df")


@query("a03_bm25_v3", f"WITH {PAPERS} SELECT doc_id, round(bm25, 6) AS bm25 FROM bm")
def a03(t: Tables):
    return search.bm25(papers(t), QUERY).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query("l01_search_top", f"WITH {PAPERS} SELECT doc_id, round(bm25, 6) AS bm25 FROM bm ORDER BY round(bm25, 6) DESC, doc_id LIMIT 20")
def l01(t: Tables):
    return search.bm25(papers(t), QUERY).select("doc_id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(20)


@query("f01_filters", "SELECT doc_id FROM documents WHERE lang = 'en' AND 2000 + doc_id % 25 >= 2010 AND 2000 + doc_id % 25 <= 2020")
def f01(t: Tables):
    return search.prefilter(papers(t), "en", 2010, 2020).select("doc_id")


@query("w01_snippets")
def w01(t: Tables):
    return search.snippets(papers(t), QUERY.split())


@query("l04_candidates", f"""WITH {PAPERS}, hits AS (SELECT 'hit' AS asked, doc_id, round(bm25, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 50),
    firsts AS (SELECT 'none' AS asked, doc_id, round(1 - (row_number() OVER (ORDER BY doc_id) - 1) / 50, 6) AS score FROM documents ORDER BY doc_id LIMIT 50) SELECT * FROM hits UNION ALL SELECT * FROM firsts""")
def l04(t: Tables):
    """A query that finds documents, and one of no word in any."""
    docs, order = papers(t), t.documents.select("doc_id", F.col("doc_id").alias("ord"))
    found = [search.bm25(docs, q).select("doc_id", F.round("bm25", 6).alias("score")) for q in (QUERY, "zzqxj0")]
    hit, none = (search.candidates(f, order) for f in found)
    return hit.select(F.lit("hit").alias("asked"), "doc_id", "score").unionByName(none.select(F.lit("none").alias("asked"), "doc_id", F.round("score", 6).alias("score")))


@query("l05_evidence_sources", f"""WITH {PAPERS}, best AS (SELECT doc_id, round(bm25, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 6),
    p AS (SELECT doc_id, score, ls[1] AS title, unnest(range(1, greatest(1, CAST(ceil(len(ls) / 20) AS BIGINT)) + 1)) AS page, ls FROM (SELECT doc_id, score, string_split(text, chr(10)) AS ls FROM best JOIN documents USING (doc_id))),
    h AS (SELECT doc_id, score, title, page, len(list_intersect(['attion', 'ertion', 'retion'], {TOK.format("array_to_string(ls[(page - 1) * 20 + 1 : page * 20], chr(10))")})) AS hits FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, page) AS nth FROM h WHERE hits > 0),
    o AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id, nth) AS place, doc_id, title, page, hits FROM r WHERE nth <= 2) SELECT * FROM o WHERE place <= 8""")
def l05(t: Tables):
    docs = papers(t)
    found = search.bm25(docs, QUERY).select("doc_id", F.round("bm25", 6).alias("score"))
    rows = search.evidence(found, docs, QUERY.split())
    return rows.select(*(F.col(c).cast("long").alias(c) for c in ("place", "doc_id", "page", "hits")), "title")


@query("t36_linear_score", "SELECT event_id, round(0.4 * v + 0.3 * (1 - v) + 0.15 * v + 0.1 * (v / 2) + 0.05, 6) AS score FROM (SELECT event_id, value / 1000 AS v FROM events)")
def t36(t: Tables):
    v = F.col("value") / 1000
    return t.events.select("event_id", F.round(search.linear_score(v, 1 - v, v, v / 2, F.lit(1.0)), 6).alias("score"))


@query("t37_hybrid_score", f"""WITH {PAPERS} SELECT b.doc_id, round((b.bm25 / m.m * 40 + pow(0.5, greatest(0, {AS_OF} - p.year) / 5.0) * 15) / 100, 6) AS score FROM bm b JOIN papers p USING (doc_id), (SELECT max(bm25) AS m FROM bm) m""")
def t37(t: Tables):
    rows = search.bm25(papers(t), QUERY)
    top = F.broadcast(rows.agg(F.greatest(F.max("bm25"), F.lit(1e-9)).alias("top")))
    scored = rows.crossJoin(top).join(papers(t).select("doc_id", "year"), "doc_id")
    return scored.select("doc_id", F.round(search.hybrid_score({"relevance": F.col("bm25") / F.col("top"), "recency": search.recency(F.col("year"), AS_OF)}), 6).alias("score"))


@query("t38_recency_v3", f"SELECT doc_id, round(pow(0.5, greatest(0, {AS_OF} - (2000 + doc_id % 25)) / 5.0), 6) AS recency FROM documents")
def t38(t: Tables):
    return papers(t).select("doc_id", F.round(search.recency(F.col("year"), AS_OF), 6).alias("recency"))


@query("t39_recency_edge_v1", f"SELECT doc_id, round(0.7 + 0.3 * exp(-({AS_OF} - (2000 + doc_id % 25)) / 8.0), 6) AS factor FROM documents")
def t39(t: Tables):
    return papers(t).select("doc_id", F.round(search.recency_edge(F.col("year"), AS_OF), 6).alias("factor"))


@query("t40_recency_node_v1", f"SELECT doc_id, round(greatest(0, 1 - ({AS_OF} - (2000 + doc_id % 25)) / 20.0), 6) AS recency FROM documents")
def t40(t: Tables):
    return papers(t).select("doc_id", F.round(search.recency_node(F.col("year"), AS_OF), 6).alias("recency"))


@query("t41_roles", "SELECT event_id, CASE WHEN value / 500 > 0.85 THEN 'frontier' WHEN (event_id % 10) / 10.0 > 0.8 THEN 'hub' ELSE 'foundation' END AS role FROM events")
def t41(t: Tables):
    return t.events.select("event_id", search.role(F.col("value") / 500, (F.col("event_id") % 10) / 10).alias("role"))


@query("w03_rank_scale", "SELECT doc_id, round(0.45 + 0.5 * (row_number() OVER (ORDER BY n_chars, doc_id) - 1) / (count(*) OVER () - 1), 6) AS total FROM documents")
def w03(t: Tables):
    """Ranks by range: counts of ranges of the key, and a window inside each, so that no task sorts all rows."""
    rows = t.documents.select("doc_id", "n_chars", F.expr("shiftright(n_chars, 6)").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("bucket", (F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("n"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("n_chars", "doc_id")) - 1 + F.col("before")
    return rows.join(F.broadcast(before), "bucket").select("doc_id", F.round(F.when(F.col("n") == 1, 0.65).otherwise(0.45 + 0.5 * rank / (F.col("n") - 1)), 6).alias("total"))


@query("w04_minmax", "SELECT event_id, round(CASE WHEN hi - lo > 1e-9 THEN 0.55 + 0.4 * ((value - lo) / (hi - lo)) ELSE 0.75 END, 6) AS feature FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)")
def w04(t: Tables):
    ends = F.broadcast(t.events.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    span = F.col("hi") - F.col("lo")
    return t.events.crossJoin(ends).select("event_id", F.round(F.when(span > 1e-9, 0.55 + 0.4 * ((F.col("value") - F.col("lo")) / span)).otherwise(0.75), 6).alias("feature"))


@query("w05_over_max", "SELECT event_id, round(value / greatest((SELECT max(value) FROM events), 1e-9), 6) AS share FROM events")
def w05(t: Tables):
    top = F.broadcast(t.events.agg(F.greatest(F.max("value"), F.lit(1e-9)).alias("top")))
    return t.events.crossJoin(top).select("event_id", F.round(F.col("value") / F.col("top"), 6).alias("share"))


# -- similarity -------------------------------------------------------------------------------------------------

TITLE_SETS = "sets AS (SELECT doc_id AS id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 1)) AS terms FROM documents)"


def title_sets(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), T.title_tokens(F.split("text", "\n")[0]).alias("terms"))


@query("u01_jaccard_pairs", f"""WITH {TITLE_SETS} SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.terms, b.terms)) / len(list_distinct(a.terms || b.terms)), 6) AS score
    FROM sets a JOIN sets b ON a.id < b.id WHERE len(a.terms) > 0 AND len(b.terms) > 0 AND len(list_intersect(a.terms, b.terms)) / len(list_distinct(a.terms || b.terms)) > 0.2""")
def u01(t: Tables):
    return similarity.jaccard_pairs(title_sets(t), 0.2).withColumn("score", F.round("score", 6))


@query("u02_title_similarity", f"""WITH {TITLE_SETS}, pairs AS (SELECT a.id, len(list_intersect(a.terms, b.terms)) AS x, len(a.terms) AS na, len(b.terms) AS nb, len(list_distinct(a.terms || b.terms)) AS u FROM sets a JOIN sets b ON b.id = a.id + 1)
    SELECT id, round(CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE 0.6 * x / least(na, nb) + 0.4 * x / u END, 6) AS score FROM pairs""")
def u02(t: Tables):
    a = title_sets(t)
    b = a.select((F.col("id") - 1).alias("id"), F.col("terms").alias("other"))
    return a.join(b, "id").select("id", F.round(similarity.title_similarity(F.col("terms"), F.col("other")), 6).alias("score"))


REL = "list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 1)"
VECTORS = f"""vectors AS (SELECT id, term, sum(w) AS weight FROM (
    SELECT doc_id AS id, unnest({REL.format('string_split(text, chr(10))[1]')}) AS term, 5.0 AS w FROM documents UNION ALL SELECT doc_id, unnest({REL.format('left(text, 2000)')}), 1.0 FROM documents) GROUP BY id, term)"""


#: What an occurrence of a term counts, by where it stands.
PARTS = {"title": 5.0, "body": 1.0}


def term_rows(t: Tables, body: str = "left(text, 2000)") -> DataFrame:
    """(id, title, body): the terms of each, repeats kept."""
    return t.documents.select(F.col("doc_id").alias("id"), T.related_tokens(F.split("text", "\n")[0]).alias("title"), T.related_tokens(F.expr(body)).alias("body"))


def vectors(t: Tables) -> DataFrame:
    return similarity.weighted_terms(term_rows(t), PARTS, pieces(t.documents))


@query("a04_weighted_terms", f"WITH {VECTORS} SELECT id, term, weight FROM vectors")
def a04(t: Tables):
    return vectors(t)


@query("a05_norms", f"WITH {VECTORS} SELECT id, round(sqrt(sum(weight * weight)), 6) AS norm FROM vectors GROUP BY id")
def a05(t: Tables):
    return vectors(t).groupBy("id").agg(F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"))


RELATED = f"""WITH {VECTORS}, norms AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM vectors GROUP BY id),
    pairs AS (SELECT x.id AS a, y.id AS b, sum(x.weight * y.weight) / (any_value(n.norm) * any_value(m.norm)) AS weight FROM vectors x JOIN vectors y ON x.term = y.term AND x.id < y.id JOIN norms n ON n.id = x.id JOIN norms m ON m.id = y.id GROUP BY x.id, y.id)"""


@query("j05_cosine_pairs", RELATED.replace("left(text, 2000)", "text") + " SELECT a, b, round(weight, 6) AS weight FROM pairs WHERE weight >= 0.08")
def j05(t: Tables):
    """Cosine over all terms of whole texts."""
    return similarity.cosine_pairs(term_rows(t, "text"), PARTS, 0.08).withColumn("weight", F.round("weight", 6))


TOP3 = RELATED + """, ends AS (SELECT a, b, round(weight, 9) AS weight, a AS node, b AS other FROM pairs WHERE weight >= 0.08 UNION ALL SELECT a, b, round(weight, 9), b, a FROM pairs WHERE weight >= 0.08)
    SELECT DISTINCT a, b FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS r FROM ends) WHERE r <= 3"""


@query("w02_top3_neighbours", TOP3)
def w02(t: Tables):
    return similarity.top_neighbours(term_rows(t), PARTS, 0.08).select("a", "b")


@query("k17_relatedness", TOP3)
def k17(t: Tables):
    """The relatedness graph: cosine pairs cut to the heaviest three of either end."""
    return similarity.top_neighbours(term_rows(t), PARTS, 0.08).select("a", "b")


@query("j04_title_tag_jaccard", f"""WITH s AS (SELECT doc_id AS id, list_distinct({TOK.format("string_split(text, chr(10))[1] || ' ' || lang || ' ' || source")}) AS terms FROM documents)
    SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.terms, b.terms)) / len(list_distinct(a.terms || b.terms)), 6) AS score FROM s a JOIN s b ON a.id < b.id WHERE len(list_intersect(a.terms, b.terms)) / len(list_distinct(a.terms || b.terms)) > 0.2""")
def j04(t: Tables):
    terms = F.array_distinct(T.tokens(F.concat_ws(" ", F.split("text", "\n")[0], "lang", "source")))
    return similarity.jaccard_pairs(t.documents.select(F.col("doc_id").alias("id"), terms.alias("terms")), 0.2).withColumn("score", F.round("score", 6))


@query("j03_containment_edges", "SELECT b.item_id AS needle, d.doc_id AS doc, instr(d.text, b.text) AS at FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def j03(t: Tables):
    needles = t.benchmark.select(F.col("item_id").alias("needle"), "text")
    return similarity.containment_pairs(needles, t.documents.select(F.col("doc_id").alias("doc"), F.col("text").alias("body"))).withColumn("at", F.col("at").cast("long"))


@query("f05_citation_titles", "SELECT doc_id FROM documents WHERE length(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\\p{L}\\p{N}]', '', 'g')) >= 20 AND len(regexp_extract_all(string_split(text, chr(10))[1], '[\\p{L}\\p{N}]+')) >= 4")
def f05(t: Tables):
    return t.documents.where(F.size(T.citation_titles(F.split("text", "\n")[0])) > 0).select("doc_id")


# -- graphs -----------------------------------------------------------------------------------------------------

SAVED = "saved AS (SELECT doc_id AS source, (doc_id * 7 + 1) % 1500 AS target, 'background' AS relation, coalesce(toxic, 0) = 1 AS excluded FROM labels)"
AUTO = "automatic AS (SELECT DISTINCT o_custkey % 1500 AS source, (o_orderkey * 7 + 1) % 1500 AS target, 'validates' AS relation FROM orders)"


def saved_edges(t: Tables) -> DataFrame:
    return t.labels.select(F.col("doc_id").alias("source"), ((F.col("doc_id") * 7 + 1) % 1500).alias("target"), F.lit("background").alias("relation"), (F.coalesce("toxic", F.lit(0)) == 1).alias("excluded"))


def automatic_edges(t: Tables) -> DataFrame:
    return t.orders.select((F.col("o_custkey") % 1500).alias("source"), ((F.col("o_orderkey") * 7 + 1) % 1500).alias("target"), F.lit("validates").alias("relation")).distinct()


@query("k03_graph_edges", f"""WITH {SAVED}, {AUTO}, valid AS (SELECT * FROM saved WHERE source IN (SELECT doc_id FROM documents) AND target IN (SELECT doc_id FROM documents))
    SELECT source, target, relation, true AS confirmed FROM valid WHERE NOT excluded UNION ALL SELECT a.source, a.target, a.relation, false FROM automatic a WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.source = a.source AND v.target = a.target)""")
def k03(t: Tables):
    return graph.graph_edges(saved_edges(t), automatic_edges(t), t.documents.select(F.col("doc_id").alias("id")))


@query("j06_auto_minus_saved", f"WITH {SAVED}, {AUTO} SELECT a.source, a.target FROM automatic a WHERE NOT EXISTS (SELECT 1 FROM saved v WHERE v.source = a.source AND v.target = a.target)")
def j06(t: Tables):
    return automatic_edges(t).join(saved_edges(t).select("source", "target"), ["source", "target"], "left_anti").select("source", "target")


@query("j07_valid_edges", f"WITH {SAVED} SELECT source, target FROM saved WHERE source IN (SELECT doc_id FROM documents) AND target IN (SELECT doc_id FROM documents)")
def j07(t: Tables):
    ids = t.documents.select(F.col("doc_id").alias("source"))
    return saved_edges(t).join(ids, "source", "left_semi").join(t.documents.select(F.col("doc_id").alias("target")), "target", "left_semi").select("source", "target")


same("u04_edge_union", "SELECT doc_id AS source, doc_id % 97 AS target, 'confirmed' AS kind FROM {labels} WHERE quality = 1 UNION ALL SELECT o_custkey, o_orderkey % 97, 'automatic' FROM {orders}")
same("j09_neighbours", "SELECT node, count(DISTINCT other) AS n FROM (SELECT o_custkey % 100 AS node, o_orderkey % 100 AS other FROM {orders} UNION ALL SELECT o_orderkey % 100, o_custkey % 100 FROM {orders}) e WHERE node <> other GROUP BY node")
same("a06_node_strength", "SELECT node, round(sum(w), 4) AS strength FROM (SELECT o_custkey AS node, o_totalprice AS w FROM {orders} UNION ALL SELECT o_orderkey % 1000, o_totalprice FROM {orders}) e GROUP BY node")
same("j08_default_scores", "SELECT d.doc_id, coalesce(l.quality, 0) AS score FROM {documents} d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM {labels} GROUP BY doc_id) l ON d.doc_id = l.doc_id")
same("j27_graph_nodes", "SELECT c.c_custkey AS id, coalesce(s.role, 'foundation') AS role, coalesce(s.total, 0) AS total FROM {customer} c LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS role, count(*) AS total FROM {orders} GROUP BY o_custkey) s ON c.c_custkey = s.o_custkey")
same("j01_analyses", "SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")


@query("k04_edge_dedup", """WITH e AS (SELECT o_custkey % 50 AS source, o_orderkey % 50 AS target, CASE WHEN o_orderkey % 3 = 0 THEN 'related' ELSE o_orderpriority END AS relation, o_totalprice AS weight, o_orderkey AS ord FROM orders),
    r AS (SELECT *, max(weight) OVER (PARTITION BY source, target ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM e)
    SELECT source, target, max(weight) AS weight, coalesce(arg_min(relation, ord) FILTER (WHERE relation <> 'related'), 'related') AS relation FROM r WHERE most IS NULL OR weight > most GROUP BY source, target""")
def k04(t: Tables):
    return graph.merge_edges(t.orders.select((F.col("o_custkey") % 50).alias("source"), (F.col("o_orderkey") % 50).alias("target"), F.when(F.col("o_orderkey") % 3 == 0, "related").otherwise(F.col("o_orderpriority")).alias("relation"), F.col("o_totalprice").alias("weight"), F.col("o_orderkey").alias("ord")))


RELATION = "CASE l_returnflag WHEN 'A' THEN 'foundation' WHEN 'N' THEN 'background' ELSE 'extends' END"
#: The SQL has no loop that ends by a tolerance: so many rounds are past it, compared to 7 digits.
ROUNDS = 40
RANK_STEP = "SELECT n.id, 0.15 * n.p + 0.85 * (coalesce(g.got, 0) + l.loose * n.p) AS rank FROM nodes n LEFT JOIN (SELECT s.target AS id, sum(r.rank * s.share) AS got FROM shares s JOIN {0} r ON r.id = s.source GROUP BY s.target) g ON g.id = n.id, (SELECT coalesce(sum(rank), 0) AS loose FROM {0} WHERE id NOT IN (SELECT source FROM shares)) l"
RANKS = ", ".join(f"r{k + 1} AS MATERIALIZED (" + RANK_STEP.format(f"r{k}") + ")" for k in range(ROUNDS))


def supply_edges(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_partkey") % 300).alias("source"), (F.col("l_suppkey") % 300).alias("target"), F.when(F.col("l_returnflag") == "A", "foundation").when(F.col("l_returnflag") == "N", "background").otherwise("extends").alias("relation"))


@query("k01_pagerank_v3", f"""WITH edges AS (SELECT l_partkey % 300 AS source, l_suppkey % 300 AS target, CASE {RELATION} WHEN 'foundation' THEN 1.25 WHEN 'background' THEN 0.55 ELSE 1.1 END AS w FROM lineitem),
    nodes AS (SELECT range AS id, 1.0 / 320 AS p FROM range(320)), shares AS MATERIALIZED (SELECT e.source, e.target, sum(e.w) / any_value(o.w) AS share FROM edges e JOIN (SELECT source, sum(w) AS w FROM edges GROUP BY source) o ON o.source = e.source GROUP BY e.source, e.target),
    r0 AS MATERIALIZED (SELECT id, p AS rank FROM nodes), {RANKS} SELECT id, round(rank, 7) AS rank FROM r{ROUNDS}""")
def k01(t: Tables):
    nodes = t.spark.range(320).withColumn("p", F.lit(0.0))
    return graph.page_rank(nodes, graph.ranked_edges_v3(supply_edges(t))).withColumn("rank", F.round("rank", 7))


@query("k02_pagerank_v1", f"""WITH edges AS (SELECT l_partkey % 300 AS source, l_suppkey % 300 AS target, CASE {RELATION} WHEN 'foundation' THEN 1.25 WHEN 'background' THEN 0.55 ELSE 1.1 END * (CASE WHEN l_partkey % 300 = l_suppkey % 300 THEN 0.7 ELSE 1.0 END) * (0.7 + 0.3 * exp(-({AS_OF} - (2000 + (l_suppkey % 300) % 25)) / 8.0)) AS w FROM lineitem),
    nodes AS (SELECT range AS id, (1.0 + range % 7) / (SELECT sum(1.0 + range % 7) FROM range(320)) AS p FROM range(320)), shares AS MATERIALIZED (SELECT e.source, e.target, sum(e.w) / any_value(o.w) AS share FROM edges e JOIN (SELECT source, sum(w) AS w FROM edges GROUP BY source) o ON o.source = e.source GROUP BY e.source, e.target),
    r0 AS MATERIALIZED (SELECT id, p AS rank FROM nodes), {RANKS} SELECT id, round(rank / (SELECT sum(rank) FROM r{ROUNDS}), 7) AS rank FROM r{ROUNDS}""")
def k02(t: Tables):
    edges = supply_edges(t).withColumns({"weight": F.lit(1.0), "year": 2000 + (F.col("target") % 25).cast("int"), "self_citation": F.col("source") == F.col("target")})
    nodes = t.spark.range(320).withColumn("p", 1.0 + F.col("id") % 7)
    return graph.page_rank(nodes, graph.ranked_edges_v1(edges, AS_OF), iterations=100, tolerance=1e-8, rescale=True).withColumn("rank", F.round("rank", 7))


@query("u08_closure", """WITH RECURSIVE g AS (SELECT o_orderkey % 200 // 8 AS grp, o_orderkey % 200 AS member FROM orders UNION SELECT 1000 + o_orderkey % 200 // 12, o_orderkey % 200 FROM orders), reach(member) AS (
    SELECT 0::BIGINT UNION SELECT b.member FROM reach r JOIN g a ON a.member = r.member JOIN g b ON b.grp = a.grp) SELECT member FROM reach""")
def u08(t: Tables):
    member = F.col("o_orderkey") % 200
    groups = t.orders.select(F.floor(member / 8).alias("grp"), member.alias("member")).union(t.orders.select(1000 + F.floor(member / 12), member)).distinct()
    return graph.closure(t.spark.range(1).withColumnRenamed("id", "member"), groups)


@query("k05_cycle", """WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS source, (n_nationkey * 3 + n_regionkey) % 25 AS target FROM nation), reach(a, b) AS (SELECT source, target FROM e UNION SELECT r.a, e.target FROM reach r JOIN e ON e.source = r.b)
    SELECT count(*) > 0 AS cyclic FROM reach WHERE a = b""")
def k05(t: Tables):
    edges = t.nation.select(F.col("n_nationkey").alias("source"), ((F.col("n_nationkey") * 3 + F.col("n_regionkey")) % 25).alias("target"))
    return graph.in_cycles(edges).agg((F.count(F.lit(1)) > 0).alias("cyclic"))


@query("k06_chains", """WITH RECURSIVE l AS (SELECT n_nationkey AS source, n_nationkey + 5 AS target FROM nation WHERE n_nationkey + 5 IN (SELECT n_nationkey FROM nation)), c(head, node, pos) AS (
    SELECT source, source, 0 FROM l WHERE source NOT IN (SELECT target FROM l) UNION ALL SELECT c.head, l.target, c.pos + 1 FROM c JOIN l ON l.source = c.node) SELECT head, node, pos FROM c""")
def k06(t: Tables):
    ends = t.nation.select((F.col("n_nationkey") - 5).alias("n_nationkey"))
    links = t.nation.join(ends, "n_nationkey", "left_semi").select(F.col("n_nationkey").alias("source"), (F.col("n_nationkey") + 5).alias("target"))
    return graph.chains(links)


@query("l03_mmr_v1")
def l03(t: Tables):
    """15 diverse documents of all that match, by domain and terms."""
    hits = search.bm25(papers(t), QUERY).join(papers(t).select("doc_id", "tags", "title"), "doc_id")
    top = F.broadcast(hits.agg(F.max("bm25").alias("top")))
    terms = F.array_union(F.transform("tags", lambda x: F.concat(F.lit("d:"), x)), F.transform(T.title_tokens(F.col("title")), lambda x: F.concat(F.lit("t:"), x)))
    rows = hits.crossJoin(top).select(F.col("doc_id").alias("id"), (F.col("bm25") / F.col("top")).alias("score"), terms.alias("terms"))
    return search.mmr(rows, 15, 1 - 0.72, 0.72)


@query("l02_mmr_v3")
def l02(t: Tables):
    hits = search.bm25(papers(t), QUERY).join(papers(t).select("doc_id", "tags", "title"), "doc_id")
    top = F.broadcast(hits.agg(F.max("bm25").alias("top")))
    terms = F.array_distinct(T.tokens(F.concat_ws(" ", "title", F.array_join("tags", " "))))
    rows = hits.crossJoin(top).select(F.col("doc_id").alias("id"), (F.col("bm25") / F.col("top")).alias("score"), terms.alias("terms"))
    return search.mmr(rows, 10, 0.15)
