"""Queries of references, publishers' lines, spans and expanded searches, over ``documents``, ``conversations`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import references, sections
from .registry import DERIVED, Tables, query

LINES = DERIVED["lines"][1]
FIRST = "string_split(coalesce(text, ''), chr(10))[1]"
PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
SET = "list_distinct(list_filter(string_split({0}, ' '), lambda x: length(x) > 1))"


@query("j02_reference_matches", f"""WITH d AS (SELECT doc_id, {FIRST} AS title FROM documents),
    papers AS (SELECT doc_id AS paper, CASE WHEN doc_id % 4 = 0 THEN '10.1/d' || (doc_id // 8) END AS doi, {PLAIN.format('title')} AS plain FROM d),
    refs AS (SELECT doc_id AS ref, doc_id + 1 AS owner, CASE WHEN doc_id % 5 = 0 THEN '10.1/d' || (doc_id // 8) END AS doi, {PLAIN.format("CASE doc_id % 3 WHEN 0 THEN '«' || title || '!' WHEN 1 THEN title || ' revisited' ELSE 'on ' || title END")} AS plain FROM d),
    exact AS (SELECT r.*, coalesce((SELECT max(paper) FROM papers p WHERE p.doi = r.doi), (SELECT min(paper) FROM papers p WHERE p.plain = r.plain)) AS exact FROM refs r),
    x AS (SELECT ref, {SET.format('plain')} AS a FROM exact WHERE exact IS NULL), y AS (SELECT paper, {SET.format('plain')} AS b FROM papers),
    s AS (SELECT ref, paper, len(list_intersect(a, b)) AS n, len(a) AS na, len(b) AS nb FROM x, y WHERE len(a) > 0 AND len(b) > 0),
    near AS (SELECT ref, arg_max(paper, (score, paper)) AS near FROM (SELECT ref, paper, 0.6::DOUBLE * (n::DOUBLE / least(na, nb)) + 0.4::DOUBLE * (n::DOUBLE / (na + nb - n)) AS score FROM s) WHERE score >= 0.72::DOUBLE GROUP BY ref),
    m AS (SELECT ref, owner, doi, nullif(coalesce(exact, near), owner) AS paper FROM exact LEFT JOIN near USING (ref))
    SELECT ref, owner, coalesce(paper, -1) AS paper, CASE WHEN paper IS NULL THEN 0::DOUBLE WHEN doi IS NULL THEN 0.82::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM m""")
def j02(t: Tables):
    """Each document is cited once, by the next one, under its first line, with marks around it or with a word more."""
    d = t.documents.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("title"))
    number = F.expr("doc_id div 8").cast("string")
    papers = d.select(F.col("doc_id").alias("paper"), "title", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://doi.org/10.1/D"), number)).alias("doi"), F.col("doc_id").alias("ord"))
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("«"), "title", F.lit("!"))).when(F.col("doc_id") % 3 == 1, F.concat("title", F.lit(" revisited"))).otherwise(F.concat(F.lit("on "), "title"))
    refs = d.select(F.col("doc_id").alias("ref"), (F.col("doc_id") + 1).alias("owner"), name.alias("title"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("10.1/d"), number)).alias("doi"))
    return references.match_references(refs, papers).fillna({"paper": -1, "confidence": 0.0})


@query("f13_publisher_lines", f"""SELECT doc_id, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE pos NOT IN (1, 2, 3, 4, 7)), ''), '^\\s+|\\s+$', '', 'g') AS text FROM {LINES} GROUP BY doc_id""")
def f13(t: Tables):
    """Lines of documents; the second to the fifth are made a notice of permission, the eighth an imprint."""
    lines = DERIVED["lines"][0](t)
    line = F.when(F.col("pos") == 1, "Permission to make digital or hard copies of all").when(F.col("pos") == 4, "see https://doi.org/10.1/x").when(F.col("pos") == 7, "© 2024 Copyright held by the owner").otherwise(F.col("line"))
    return sections.without_publisher_lines(lines.select("doc_id", "pos", line.alias("line")), "doc_id", "pos", "line")


ENTRY = "text || CASE turn % 4 WHEN 0 THEN ' inter-' WHEN 1 THEN ' https://a.org/' WHEN 2 THEN ' pages 10-' ELSE ' end' END"
NEXT = "CASE turn % 4 WHEN 0 THEN 'national' WHEN 1 THEN 'b/c' WHEN 2 THEN '20' ELSE role END"


@query("t65_continued_entry", f"SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' international' WHEN 1 THEN ' https://a.org/b/c' WHEN 2 THEN ' pages 10-20' ELSE ' end ' || role END AS entry FROM conversations")
def t65(t: Tables):
    rows = t.conversations.selectExpr("conv_id", "turn", f"{ENTRY} AS entry", f"{NEXT} AS next")
    return rows.select("conv_id", "turn", R.continue_entry(F.col("entry"), F.col("next")).alias("entry"))


@query("t60_valid_spans", """WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
    u AS (SELECT doc_id, unnest(w[1:4]) AS x FROM w) SELECT w.doc_id, coalesce(string_agg(x || ' ', '' ORDER BY x), '') AS spans FROM w LEFT JOIN (SELECT DISTINCT doc_id, x FROM u) u USING (doc_id) GROUP BY w.doc_id""")
def t60(t: Tables):
    """The first four words as spans of a document and itself, with two that aren't there."""
    words = F.slice(F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), " "), lambda x: x != ""), 1, 4)
    both = F.transform(words, lambda x: F.struct(F.concat(x, F.lit(" ")).alias("left"), F.concat(F.lit(" "), x).alias("right")))
    more = F.array(F.struct(F.lit("\u0001").alias("left"), F.lit("").alias("right")), F.struct(F.lit(" ").alias("left"), F.lit("a").alias("right")))
    spans = R.valid_spans(F.col("text"), F.col("text"), F.concat(both, more))
    return t.documents.select("doc_id", F.array_join(F.transform(spans, lambda s: s["left"]), "").alias("spans"))


@query("u03_expanded_query", "SELECT DISTINCT role, turn, 'tsv ' || role || ' ' || turn || ' tsv through-silicon-via thermal 3d-integration ' || role || ' ' || turn || ' more' AS expanded FROM conversations")
def u03(t: Tables):
    rows = t.conversations.select("role", "turn").distinct()
    asked = F.concat_ws(" ", F.lit("tsv"), "role", F.col("turn").cast("string"))
    return rows.select("role", "turn", R.expanded_query(asked, F.array(F.lit("more"), F.lit("thermal"))).alias("expanded"))


@query("k11_anchors", f"""WITH l AS (SELECT doc_id, pos, line, CASE WHEN regexp_matches(trim(line), '(?i)^abstract') THEN 'abstract' WHEN regexp_matches(trim(line), '^\\d+(?:\\.\\d+)*\\s') THEN 'sec' || regexp_extract(trim(line), '^(\\d+(?:\\.\\d+)*)\\s', 1) END AS label FROM {LINES})
    SELECT doc_id AS doc, CASE WHEN pos % 5 = 3 THEN 'fig' || pos ELSE label END AS label, CASE WHEN pos % 5 = 3 THEN 'caption' ELSE 'section' END AS kind, pos AS block FROM l WHERE pos % 5 = 3 OR label IS NOT NULL""")
def k11(t: Tables):
    """Lines as headings; every fifth one is a figure that has only a caption."""
    figure = F.col("pos") % 5 == 3
    rows = DERIVED["lines"][0](t).select(
        F.col("doc_id").alias("doc"), F.col("pos").cast("long").alias("block"), F.col("pos").alias("ord"), F.when(figure, "figure").otherwise("section").alias("kind"),
        F.when(~figure, F.col("line")).alias("text"), F.when(figure, F.concat(F.lit(" Figure "), F.col("pos").cast("string"), F.lit(": x "))).alias("caption"),
    )
    return sections.anchors(rows).select("doc", "label", "kind", "block")


HEADINGS = "CASE pos % 4 WHEN 0 THEN n || ' Background  ' || n || '.1 Motivation and ' || lang WHEN 1 THEN 'IV. Results' || {nl} || 'B. Detail' WHEN 2 THEN 'Plain 3 words' ELSE '1.2.3 Deep' END"


@query("t27_heading_parts", f"""WITH l AS (SELECT doc_id, pos, pos % 90 + 1 AS n, lang FROM {LINES})
    SELECT doc_id, pos, 0 AS nth, CASE pos % 4 WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN 'IV' WHEN 2 THEN '' ELSE '1.2.3' END AS number, CASE WHEN pos % 4 = 3 THEN 3 ELSE 1 END AS level, CASE pos % 4 WHEN 0 THEN 'Background' WHEN 1 THEN 'Results' WHEN 2 THEN 'Plain 3 words' ELSE 'Deep' END AS text FROM l
    UNION ALL SELECT doc_id, pos, 1, CASE pos % 4 WHEN 0 THEN n || '.1' ELSE 'B' END, 2, CASE pos % 4 WHEN 0 THEN 'Motivation and ' || lang ELSE 'Detail' END FROM l WHERE pos % 4 < 2""")
def t27(t: Tables):
    """Headings of four kinds by a line's place."""
    rows = DERIVED["lines"][0](t).selectExpr("doc_id", "bigint(pos) AS pos", "lang", "pos % 90 + 1 AS n").selectExpr("doc_id", "pos", HEADINGS.format(nl="'\\n'") + " AS source")
    parts = rows.select("doc_id", "pos", F.posexplode(R.heading_parts(F.col("source"))).alias("nth", "part"))
    return parts.select("doc_id", "pos", F.col("nth").cast("int").alias("nth"), F.coalesce("part.number", F.lit("")).alias("number"), F.col("part.level").cast("int").alias("level"), "part.text")


@query("t18_restored_heading", f"SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN n || ' Titel hier 1' || n WHEN 1 THEN n || '. Titel' ELSE 'Titel' END AS heading FROM (SELECT doc_id, pos, (pos % 9 + 1) || '.' || (pos % 7 + 1) AS n FROM {LINES})")
def t18(t: Tables):
    rows = DERIVED["lines"][0](t).selectExpr("doc_id", "bigint(pos) AS pos", "(pos % 9 + 1) || '.' || (pos % 7 + 1) AS n")
    target = F.expr("CASE pos % 3 WHEN 0 THEN 'Titel ' || n || ' hier 1' || n WHEN 1 THEN n || '. Titel' ELSE 'Titel' END")
    return rows.select("doc_id", "pos", R.restored_heading(F.concat("n", F.lit(" Title")), target).alias("heading"))
