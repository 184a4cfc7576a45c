"""Queries of document rules and sections, over ``documents``, ``lineitem``, ``orders`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import sections
from .registry import DERIVED, Tables, query

LINES = DERIVED["lines"][1]
NUMBERED = r"(?i)\b(?:fig(?:ure)?|table|algorithm|code)\s*\.?\s*(?:\d+(?:[.-]\d+)*|[IVXLCDM]+)\b"


def lines(t: Tables):
    return DERIVED["lines"][0](t)


@query("u06_ordered_distinct", "WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT d.doc_id, coalesce(string_agg(x, ' ' ORDER BY place), '') AS words FROM w d LEFT JOIN (SELECT doc_id, x, min(place) AS place FROM (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS place FROM w) GROUP BY doc_id, x) u USING (doc_id) GROUP BY d.doc_id")
def u06(t: Tables):
    return t.documents.select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("l07_sample_pages", """WITH p AS (SELECT doc_id, n_chars % 40 + 1 AS n FROM documents),
    x AS (SELECT doc_id, unnest(list_distinct([1, n, CASE WHEN n > 2 THEN ceil(n / 2) END, CASE WHEN n > 4 THEN ceil(n / 4) END, CASE WHEN n > 6 THEN ceil(n * 3 / 4) END])) AS page FROM p),
    r AS (SELECT doc_id, CAST(page AS BIGINT) AS page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS nth FROM x WHERE page IS NOT NULL)
    SELECT doc_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM r WHERE nth <= 4 GROUP BY doc_id""")
def l07(t: Tables):
    pages = R.sample_pages(F.col("n_chars") % 40 + 1)
    return t.documents.select("doc_id", F.array_join(F.transform(pages, lambda x: x.cast("string")), ",").alias("pages"))


@query("t48_issue_fingerprint", "SELECT l_orderkey, l_linenumber, concat_ws('|', l_orderkey, l_returnflag, CAST(floor(l_quantity / 10 + 0.5) * 10 AS BIGINT), CAST(floor(l_partkey / 10 + 0.5) * 10 AS BIGINT), CAST(floor(l_suppkey / 10 + 0.5) * 10 AS BIGINT), CAST(floor(l_extendedprice / 10 + 0.5) * 10 AS BIGINT), lower(trim(' Line ' || l_linestatus || ' '))) AS fingerprint FROM lineitem")
def t48(t: Tables):
    box = [F.col(x) for x in ("l_quantity", "l_partkey", "l_suppkey", "l_extendedprice")]
    key = R.issue_key(F.col("l_orderkey"), F.col("l_returnflag"), box, F.concat(F.lit(" Line "), "l_linestatus", F.lit(" ")))
    return t.lineitem.select("l_orderkey", "l_linenumber", key.alias("fingerprint"))


@query("h33_label_identity", f"""WITH l AS (SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN 'Fig. ' || pos WHEN 1 THEN 'See Table IV.' ELSE '' END || ' ' || line AS line FROM {LINES}),
    m AS (SELECT doc_id, pos, lower(regexp_extract(line, '{NUMBERED}')) AS m FROM l)
    SELECT doc_id, pos, CASE WHEN m <> '' THEN CASE WHEN m LIKE 'fig%' THEN 'figure' ELSE regexp_extract(m, '^(table|algorithm|code)', 1) END || ':' || regexp_extract(m, '^(?:fig(?:ure)?|table|algorithm|code)\\s*\\.?\\s*(.*)$', 1) END AS identity FROM m""")
def h33(t: Tables):
    front = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("Fig. "), "pos")).when(F.col("pos") % 3 == 1, "See Table IV.").otherwise("")
    return lines(t).select("doc_id", F.col("pos").cast("long").alias("pos"), R.label_identity(F.concat(front, F.lit(" "), "line")).alias("identity"))


ERROR = "CASE event_id % 5 WHEN 0 THEN 'DeepSeekOutputLimitError' WHEN 1 THEN 'DeepSeekProtocolError' WHEN 2 THEN 'TranslationValidationError' WHEN 3 THEN event_type END"


@query("h30_split_errors", f"SELECT event_id, coalesce(({ERROR}) IN ('DeepSeekOutputLimitError', 'DeepSeekProtocolError', 'TranslationValidationError'), false) AS splits FROM events")
def h30(t: Tables):
    return t.events.select("event_id", R.splits_batch(F.expr(ERROR)).alias("splits"))


@query("v03_source_mapping", """SELECT o_orderkey, count(*) > 0 AND bool_and(l_linenumber = nth) AND bool_and(l_discount > 0) AS exact FROM
    (SELECT o_orderkey, l_linenumber, l_discount, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS nth FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY o_orderkey""")
def v03(t: Tables):
    """Lines as sentences, in the order of their parts as the answer; a line without discount has a blank target."""
    n = F.col("l_linenumber").cast("string")
    group = F.struct("l_partkey", "l_suppkey", "l_linenumber", F.array(n).alias("src"), F.array(F.when(F.col("l_discount") > 0, "t").otherwise(" ")).alias("dst"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(group)).alias("groups"))
    expected = F.transform(F.sequence(F.lit(1), F.size("groups")), lambda x: x.cast("string"))
    return rows.join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", R.exact_mapping(expected, F.col("groups")).alias("exact"))


@query("f04_bibliography", f"""WITH l AS (SELECT doc_id, CAST(pos // 4 AS BIGINT) AS page, pos, line, pos = 1 AS opens, CASE WHEN pos = 1 THEN true WHEN pos = 6 THEN false END AS state FROM {LINES}),
    s AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS inside FROM l)
    SELECT doc_id, page, string_agg(CASE WHEN opens THEN '[1]' || line ELSE line END, chr(10) ORDER BY pos) AS text FROM s WHERE inside GROUP BY doc_id, page HAVING bool_or(opens OR regexp_matches(line, '\\S'))""")
def f04(t: Tables):
    """Lines of documents with an opening heading put before the second line and a closing one for the seventh."""
    line = F.when(F.col("pos") == 1, F.concat(F.lit("References [1]"), "line")).when(F.col("pos") == 6, "Appendix A").otherwise(F.col("line"))
    rows = lines(t).select("doc_id", F.expr("bigint(pos div 4)").alias("page"), "pos", line.alias("line"))
    return sections.bibliography(rows, "doc_id", "page", "pos", "line")


@query("w19_chapters", f"""WITH l AS (SELECT doc_id, pos, line, pos % 5 = 2 AS head, count(*) FILTER (WHERE pos % 5 = 2) OVER (PARTITION BY doc_id ORDER BY pos) AS chapter FROM {LINES}),
    c AS (SELECT doc_id, chapter, left(string_agg(line, chr(10) ORDER BY pos), 6000) AS text FROM l WHERE chapter > 0 AND NOT head GROUP BY doc_id, chapter) SELECT * FROM c WHERE regexp_matches(text, '\\S')""")
def w19(t: Tables):
    return sections.chapters(lines(t), "doc_id", "pos", "line", F.col("pos") % 5 == 2)
