"""Queries of windows, layout, geometry, joins and checks that SQL expresses in both engines. Lines stand in for blocks,
line items for rectangles on pages, turns of conversations for pairs of blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import pieces, spread
from .registry import DERIVED, Tables, same


def pages(t: Tables) -> dict:
    """Rectangles dealt by page, to more tasks the more there are."""
    return {"rects": spread(DERIVED["rects"][0](t), "page", number=pieces(t.lineitem))}


def keyed(t: Tables) -> dict:
    """Orders and lines dealt by order alike; a text's SHA-256 stands for it, so that no task holds texts."""
    lines, orders = t.lineitem.select("l_orderkey"), t.orders.select("o_orderkey", "o_custkey")
    number = max(pieces(t.lineitem), pieces(t.orders))
    return {"lineitem": spread(lines, "l_orderkey", number=number), "orders": spread(orders, "o_orderkey", number=number), "documents": t.documents.select("doc_id", F.sha2("text", 256).alias("text"))}


# -- windows and sequences ----------------------------------------------------------------------------------------

HEAD = "CASE WHEN length(line) BETWEEN 1 AND 60 THEN pos END"
same("w06_current_section", f"SELECT doc_id, pos, coalesce(max({HEAD}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS section FROM {{lines}}")
same("w07_prev_next", "SELECT doc_id, pos, coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -1) AS prev, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), -1) AS next FROM {lines}")
same("w08_renumber", "SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord FROM {lines} WHERE length(trim(line)) > 0")
BAND = "SELECT *, CASE WHEN lag(wide) OVER (PARTITION BY page ORDER BY y, x, id) = wide THEN 0 ELSE 1 END AS starts FROM (SELECT *, CASE WHEN w > 100 THEN 1 ELSE 0 END AS wide FROM {rects}) q"
same("w09_bands", f"SELECT page, id, band, row_number() OVER (PARTITION BY page ORDER BY band, CASE WHEN wide = 0 AND x >= 300 THEN 1 ELSE 0 END, y, x, id) AS reading FROM (SELECT *, CAST(sum(starts) OVER (PARTITION BY page ORDER BY y, x, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS band FROM ({BAND}) r) s")
same("w10_layout_regions", "SELECT page, region, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS units FROM (SELECT *, CAST(sum(starts) OVER (PARTITION BY page ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS region FROM (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY page ORDER BY id) = kind THEN 0 ELSE 1 END AS starts FROM {rects}) q) r GROUP BY page, region")
same("w11_line_blocks", """SELECT page, block, count(*) AS n, min(y) AS top, max(y + h) AS bottom FROM (
    SELECT *, CAST(sum(CASE WHEN gap > greatest(1.4 * coalesce(mid, 0), 1.5 * h, 18) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM (
        SELECT *, median(gap) OVER (PARTITION BY page) AS mid FROM (SELECT *, y - lag(y) OVER (PARTITION BY page ORDER BY y, id) AS gap FROM {rects}) a) b) c GROUP BY page, block""")
same("w18_prior_context", "SELECT doc_id, pos, right(lag(line) OVER (PARTITION BY doc_id ORDER BY pos), 200) AS context FROM {lines}")
same("w20_flow_positions", """SELECT doc_id, pos, 16 + coalesce(CAST(sum(height + 12) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS y, height FROM (
    SELECT doc_id, pos, greatest(64, greatest(1, CAST(ceil(length(trim(line)) / 72.0) AS BIGINT)) * 24 + 32) AS height FROM {lines}) q""")
same("w21_positions", "SELECT page, id, page * 842 + y AS top, page * 842 + y + h AS bottom, row_number() OVER (PARTITION BY page ORDER BY y, id) AS place FROM {rects}")
same("w22_thin_row_clusters", "SELECT page, grp, count(*) AS n FROM (SELECT *, id - row_number() OVER (PARTITION BY page, kind ORDER BY id) AS grp FROM {rects}) q GROUP BY page, kind, grp HAVING count(*) >= 3", pages)
same("w24_last_eight", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) q WHERE r <= 8")
same("w25_order_valid", "SELECT l_orderkey, max(l_linenumber) - min(l_linenumber) + 1 = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM {lineitem} GROUP BY l_orderkey")
same("w26_continuous_mapping", "SELECT conv_id, min(CASE WHEN turn = coalesce(prev, turn - 1) + 1 THEN 1 ELSE 0 END) = 1 AS continuous FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM {conversations}) q GROUP BY conv_id")
same("w17_first_occurrence", "SELECT line AS term, doc_id, pos FROM (SELECT line, doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS r, count(*) OVER (PARTITION BY line) AS n FROM {lines}) q WHERE r = 1 AND n > 1")
same("w16_paragraph_merge", "SELECT doc_id, para, count(*) AS lines, sum(length(line)) AS chars FROM (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR right(trim(prev), 1) IN ('.', '!', '?', ':') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS para FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM {lines}) a) b GROUP BY doc_id, para".replace("sum(length(line))", "CAST(sum(length(line)) AS BIGINT)"))
same("j28_paragraph_flow", "SELECT page, flow, count(*) AS n FROM (SELECT *, CAST(sum(CASE WHEN prev IS NOT NULL AND y - prev BETWEEN 0 AND 120 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS flow FROM (SELECT *, lag(y) OVER (PARTITION BY page ORDER BY id) AS prev FROM {rects}) a) b GROUP BY page, flow", pages)
same("h07_continuation", "SELECT doc_id, pos, lower(left(line, 1)) = left(line, 1) AND length(line) > 0 AND NOT coalesce(right(trim(lag(line) OVER (PARTITION BY doc_id ORDER BY pos)), 1) IN ('.', '!', '?'), true) AS continues FROM {lines}")
same("h12_crosses_center", "SELECT page, id, coalesce(x - prev > greatest(10, 0.018 * 600) AND prev <= 300 AND x >= 300, false) AS crosses FROM (SELECT *, lag(x + w) OVER (PARTITION BY page ORDER BY x, id) AS prev FROM {rects}) q")
same("h19_source_order", "SELECT l_orderkey, sum(CASE WHEN l_linenumber <= prev THEN 1 ELSE 0 END) AS breaks FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS prev FROM {lineitem}) q GROUP BY l_orderkey".replace("sum(CASE", "CAST(sum(CASE").replace("END) AS breaks", "END) AS BIGINT) AS breaks"))
same("h11_covering_rects", "SELECT page, min(x) AS x, min(y) AS y, max(x + w) AS x1, max(y + h) AS y1 FROM {rects} WHERE id BETWEEN 2000000000 AND 4999999999 GROUP BY page")
same("h23_scroll_clamp", "SELECT event_id, least(greatest(0, 500 - 200), greatest(0, value)) AS top, abs(value - 100) > 0.5 AS echo FROM {events}")
same("h26_limits", "SELECT mode, CASE WHEN mode = 'enabled' THEN 2500 ELSE 4000 END AS tokens, CASE WHEN mode = 'enabled' THEN 4 ELSE 8 END AS blocks FROM (SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'enabled' ELSE 'disabled' END AS mode FROM {region}) q")

# -- filters --------------------------------------------------------------------------------------------------------

same("f02_library_filter", "SELECT doc_id FROM {documents} WHERE lower(concat_ws(' ', text, lang, source)) LIKE '%tion the%'")
same("f03_library_filter_v1", "SELECT o_orderkey FROM {orders} WHERE lower(concat_ws(' ', o_orderpriority, o_orderstatus)) LIKE '%urgent%'")
same("f06_active_jobs", "SELECT user_id, count(*) AS active FROM {events} WHERE event_type IN ('click', 'view') GROUP BY user_id")
same("f08_completion_gate", "SELECT o_orderkey, o_orderstatus = 'F' AND o_totalprice > 0 AND o_orderpriority <> '5-LOW' AND o_custkey IS NOT NULL AS ready FROM {orders}")
same("f09_page_furniture", "SELECT page, id, y < 0.12 * 800 AND w > 100 OR y + h > 0.92 * 800 AND w < 40 AS furniture FROM {rects}")
same("f10_repeated_margins", "SELECT line, count(DISTINCT doc_id) AS docs FROM {lines} WHERE length(trim(line)) > 0 AND (pos = 0 OR length(line) < 60) GROUP BY line HAVING count(DISTINCT doc_id) >= 2")
same("f11_repeated_lines", "SELECT line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM {lines} WHERE length(trim(line)) > 0 GROUP BY line HAVING count(DISTINCT doc_id) >= 3")
same("f14_blocking_issue", "SELECT event_id, CASE WHEN event_type = 'error' THEN value >= 50 WHEN event_type = 'click' THEN value >= 90 ELSE false END AS blocking FROM {events}")
same("f15_severity", "SELECT event_id, CASE WHEN value >= 90 THEN 'error' WHEN value >= 60 AND event_type <> 'view' THEN 'warn' WHEN value >= 30 THEN 'info' ELSE 'none' END AS severity FROM {events}")
same("f17_shape_predicates", "SELECT page, id, h / greatest(w, 1e-9) BETWEEN 1.05 AND 1.8 AND w >= 40 AS portrait, h < 60 AND w > 5 * h AS thin FROM {rects}")
same("f18_translatable", "SELECT doc_id, pos FROM {lines} WHERE length(trim(line)) > 0 AND NOT (line LIKE '[%' OR line LIKE 'http%')")
same("f19_note_validator", "SELECT page, id, x >= 0 AND y >= 0 AND x + w <= 600 AND y + h <= 800 AND w > 0 AND h > 0 AS valid FROM {rects}")
same("f20_alignment_rows", "SELECT s.page, s.id, s.x >= 0 AND t.x >= 0 AND s.w > 0 AND t.w > 0 AND s.x + s.w <= 600 AND t.x + t.w <= 600 AS valid FROM {rects} s JOIN {rects} t ON s.page = t.page AND t.id > s.id")
same("f21_portrait_regex", "SELECT doc_id, lower(text) LIKE '%portrait%' OR lower(text) LIKE '%photo of%' AS portrait FROM {documents}")

# -- joins ----------------------------------------------------------------------------------------------------------

PAIRS = "SELECT u.conv_id, u.nth, u.turn AS en, a.turn AS zh, u.text AS en_text, a.text AS zh_text FROM (SELECT * FROM {turns} WHERE role = 'user') u {0} JOIN (SELECT * FROM {turns} WHERE role = 'assistant') a ON u.conv_id = a.conv_id AND u.nth = a.nth"
same("j10_anchor_pairs", "SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.nth, a.nth) AS nth, coalesce(u.turn, -1) AS en, coalesce(a.turn, -1) AS zh FROM (SELECT * FROM {turns} WHERE role = 'user') u FULL JOIN (SELECT * FROM {turns} WHERE role = 'assistant') a ON u.conv_id = a.conv_id AND u.nth = a.nth")
same("j11_anchor_overrides", "SELECT coalesce(p.doc_id, o.doc_id) AS doc_id, coalesce(CASE WHEN o.toxic = 1 THEN 'manual' END, p.source) AS source FROM {documents} p LEFT JOIN {labels} o ON p.doc_id = o.doc_id WHERE coalesce(o.quality, 1) <> 0")
same("j13_target_geometry", """SELECT o.o_orderkey, CASE WHEN count(l.l_linenumber) = 0 THEN 0 WHEN min(CASE WHEN l.l_linestatus = 'F' THEN 1 ELSE 0 END) = 1 THEN 1 ELSE min(l.l_discount) END AS confidence
    FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey""")
same("j14_nearest", """SELECT page, id FROM (SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY dx * dx + 4 * dy * dy, id) AS r FROM (
    SELECT page, id, greatest(0, greatest(x - 300, 300 - (x + w))) AS dx, greatest(0, greatest(y - 400, 400 - (y + h))) AS dy FROM {rects}) q) s WHERE r = 1""")
same("j15_bracketing", """SELECT page, before, after, CASE WHEN before IS NULL THEN after WHEN after IS NULL THEN before WHEN after = before THEN before ELSE before + (after - before) * 0.5 END AS target
    FROM (SELECT page, max(CASE WHEN y + h / 2 <= 400 THEN y + h / 2 END) AS before, min(CASE WHEN y + h / 2 >= 400 THEN y + h / 2 END) AS after FROM {rects} GROUP BY page) q""")
same("j16_block_at_viewport", "SELECT page, coalesce(max(CASE WHEN y <= 400 THEN y END), min(y)) AS top FROM {rects} GROUP BY page")
same("j17_opposite_blocks", "SELECT u.conv_id, u.turn AS en, a.turn AS zh FROM (SELECT * FROM {turns} WHERE role = 'user') u JOIN (SELECT * FROM {turns} WHERE role = 'assistant') a ON u.conv_id = a.conv_id AND u.nth = a.nth")
AREA = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
same("j18_intersections", f"SELECT a.page, a.id AS a, b.id AS b, {AREA} AS area FROM {{rects}} a JOIN {{rects}} b ON a.page = b.page AND a.id < b.id WHERE {AREA} > 0")
same("j19_overlap_ranked", f"SELECT page, a, b FROM (SELECT a.page, a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.page, a.id ORDER BY {AREA} DESC, b.id) AS r FROM {{rects}} a JOIN {{rects}} b ON a.page = b.page AND a.id <> b.id WHERE {AREA} > 0) q WHERE r = 1")
same("j22_page_map", "SELECT target, src, score FROM (SELECT target, src, score, row_number() OVER (PARTITION BY target ORDER BY score DESC, src) AS r FROM (SELECT l_suppkey AS target, l_partkey % 50 AS src, count(*) AS score FROM {lineitem} GROUP BY l_suppkey, l_partkey % 50) q) s WHERE r <= 2")
same("j23_marker_difference", "SELECT coalesce(d.doc_id, l.doc_id) AS marker, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS problem FROM (SELECT DISTINCT doc_id FROM {documents}) d FULL JOIN (SELECT DISTINCT doc_id + 500 AS doc_id FROM {labels}) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
same("j24_integrity", """SELECT 'line-without-order' AS code, CAST(l_orderkey AS BIGINT) AS id FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_orderkey = l.l_orderkey)
    UNION ALL SELECT 'order-without-lines', o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)
    UNION ALL SELECT 'order-without-customer', o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = o.o_custkey)
    UNION ALL SELECT 'duplicate-text', min(doc_id) FROM {documents} GROUP BY text HAVING count(*) > 1""", keyed)
same("j25_asset_hashes", "SELECT coalesce(a.doc_id, b.doc_id) AS id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'unexpected' ELSE 'mismatch' END AS problem FROM {documents} a FULL JOIN (SELECT doc_id + 1 AS doc_id, text FROM {documents}) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.text <> b.text")
same("j26_cache_lookup", "SELECT d.doc_id, l.doc_id IS NOT NULL AS hit FROM {documents} d LEFT JOIN (SELECT DISTINCT doc_id FROM {labels}) l ON d.doc_id = l.doc_id")
same("j29_editor_rows", "SELECT u.conv_id, u.turn, coalesce(a.text, '') AS translation FROM (SELECT * FROM {turns} WHERE role = 'user') u LEFT JOIN (SELECT * FROM {turns} WHERE role = 'assistant') a ON u.conv_id = a.conv_id AND u.nth = a.nth")
same("j30_cascading_cache", "SELECT c.c_custkey, coalesce(max(CASE WHEN o.o_orderpriority = '1-URGENT' THEN o.o_orderkey END), max(CASE WHEN o.o_orderpriority = '2-HIGH' THEN o.o_orderkey END), max(o.o_orderkey)) AS plan FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 0 GROUP BY c.c_custkey")
same("c21_doi_lookup", "SELECT p.page_id, n.n_name AS found FROM {pages} p LEFT JOIN {nation} n ON n.n_nationkey = p.page_id % 40")
same("h01_target_words", "SELECT a.page, a.id, min(b.id) AS unit FROM {rects} a JOIN {rects} b ON a.page = b.page AND a.x BETWEEN b.x AND b.x + b.w AND a.y BETWEEN b.y AND b.y + b.h GROUP BY a.page, a.id")
same("h22_reader_model", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN false ELSE true END AS matched FROM {documents} d LEFT JOIN (SELECT DISTINCT doc_id FROM {labels}) l ON d.doc_id = l.doc_id")

# -- aggregates -----------------------------------------------------------------------------------------------------

same("a09_group_tree", "SELECT broad, focus, n, CASE WHEN n > 2 THEN 'split' ELSE 'branch' END AS shape FROM (SELECT lang AS broad, source AS focus, count(*) AS n FROM {documents} GROUP BY lang, source) q")
same("a09_group_tree_rollup", "SELECT lang, source, count(*) AS n FROM {documents} GROUP BY ROLLUP (lang, source)")
same("a10_manifest_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE l_discount >= 0.09) AS aligned, count(*) FILTER (WHERE l_discount > 0 AND l_discount < 0.09) AS low, count(*) FILTER (WHERE l_discount <= 0) AS unmatched, round(count(*) FILTER (WHERE l_discount > 0) / greatest(count(*), 1), 6) AS coverage FROM {lineitem}")
same("a11_scan_diagnostics", "SELECT count(DISTINCT doc_id) AS papers, count(*) AS lines, count(*) FILTER (WHERE length(trim(line)) = 0) AS blank FROM {lines}")
same("a12_issue_rollup", "SELECT count(*) FILTER (WHERE quality = 0) AS errors, count(*) FILTER (WHERE toxic = 1) AS warns FROM {labels}")
same("a13_approval", "SELECT user_id, min(CASE WHEN event_type = 'error' AND value > 50 THEN 0 ELSE 1 END) = 1 AS approved FROM {events} GROUP BY user_id")
same("a14_type_counts", "SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.n, 0) AS en, coalesce(b.n, 0) AS zh, coalesce(a.n, 0) = coalesce(b.n, 0) AS conserved FROM (SELECT l_returnflag AS kind, count(*) AS n FROM {lineitem} WHERE l_linestatus = 'F' GROUP BY l_returnflag) a FULL JOIN (SELECT l_returnflag AS kind, count(*) AS n FROM {lineitem} WHERE l_linestatus = 'O' GROUP BY l_returnflag) b ON a.kind = b.kind")
same("a15_dollar_marks", "SELECT lang, CAST(sum(length(text) - length(replace(text, '$', ''))) AS BIGINT) AS marks FROM {documents} GROUP BY lang")
same("a16_median_gap", "SELECT l_suppkey, median(l_quantity) AS middle FROM {lineitem} GROUP BY l_suppkey")
same("a17_remaining", "SELECT user_id, CASE WHEN count(*) < 2 THEN NULL ELSE round(1000 * median(pace), 4) END AS remaining FROM (SELECT user_id, value / (1 + event_id % 50) AS pace, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events} WHERE value > 0) q WHERE r <= 8 GROUP BY user_id")
same("a18_union_box", "SELECT page, min(x) AS x, min(y) AS y, max(x + w) AS x1, max(y + h) AS y1 FROM {rects} GROUP BY page")
same("a20_usage_totals", "SELECT event_type, round(sum(value), 4) AS total, count(*) AS n FROM {events} GROUP BY event_type")
same("a22_mean_confidence", "SELECT l_orderkey, round(avg(CASE WHEN l_discount > 0 THEN l_discount END), 6) AS mean FROM {lineitem} GROUP BY l_orderkey")
same("a23_library_size", "SELECT source, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) FILTER (WHERE n_chars > 1000) AS badge FROM {documents} GROUP BY source")
same("a24_duplicates", "SELECT min(doc_id) AS first, count(*) AS n FROM {documents} GROUP BY text HAVING count(*) > 1")
same("a08_richness", "SELECT d.doc_id, round(2 * coalesce(l.quality, 0) + n_chars / CAST(5000 AS DOUBLE) + length(text) / CAST(500 AS DOUBLE), 6) AS richness FROM {documents} d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM {labels} GROUP BY doc_id) l ON d.doc_id = l.doc_id")
same("a07_topic_count", "SELECT o_custkey, count(DISTINCT topic) AS topics FROM (SELECT o_custkey, o_orderpriority AS topic FROM {orders} UNION ALL SELECT o_custkey, o_orderstatus FROM {orders}) q GROUP BY o_custkey")
same("a21_coverage", "SELECT round(avg(CASE WHEN b.doc_id IS NULL THEN 0 ELSE 1 END), 6) AS coverage FROM {documents} a LEFT JOIN (SELECT DISTINCT doc_id FROM {labels}) b ON a.doc_id = b.doc_id")

# -- sets -----------------------------------------------------------------------------------------------------------

same("u05_glossary_merge", "SELECT term, sense FROM (SELECT term, sense, row_number() OVER (PARTITION BY lower(term) ORDER BY prio DESC, term) AS r FROM (SELECT n_name AS term, 'model' AS sense, 1 AS prio FROM {nation} UNION ALL SELECT lower(n_name), 'detected', 2 FROM {nation} WHERE n_regionkey > 1 UNION ALL SELECT upper(n_name), 'user', 3 FROM {nation} WHERE n_regionkey > 3) q) s WHERE r = 1")
same("u07_difference", "SELECT 'missing' AS side, line FROM (SELECT line FROM {lines} WHERE lang = 'en' EXCEPT SELECT line FROM {lines} WHERE lang <> 'en') a UNION ALL SELECT 'extra', line FROM (SELECT line FROM {lines} WHERE lang <> 'en' EXCEPT SELECT line FROM {lines} WHERE lang = 'en') b")
same("u09_invalidation", "SELECT DISTINCT e.user_id, e.event_type AS artifact FROM {events} e JOIN (SELECT 'click' AS event_type, 1 AS facet UNION ALL SELECT 'view', 2 UNION ALL SELECT 'purchase', 3) f ON e.event_type = f.event_type WHERE f.facet >= 2")
same("u10_symmetric_difference", "SELECT coalesce(a.k, b.k) AS k FROM (SELECT DISTINCT l_partkey AS k FROM {lineitem} WHERE l_returnflag = 'A') a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM {lineitem} WHERE l_returnflag = 'R') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")

# -- geometry -------------------------------------------------------------------------------------------------------

same("g01_overlap_pairs", f"SELECT a.page, a.id AS a, b.id AS b, {AREA} / least(a.w * a.h, b.w * b.h) AS share FROM {{rects}} a JOIN {{rects}} b ON a.page = b.page AND a.id < b.id WHERE {AREA} > 0")
same("g02_near_pairs", "SELECT a.page, a.id AS a, b.id AS b FROM {rects} a JOIN {rects} b ON a.page = b.page AND a.id < b.id AND a.x <= b.x + b.w + 8 AND b.x <= a.x + a.w + 8 AND a.y <= b.y + b.h + 8 AND b.y <= a.y + a.h + 8")
same("g05_box_to_points", "SELECT page, id, floor(x * 595 / CAST(10 AS DOUBLE) + 0.5) / CAST(100 AS DOUBLE) AS x, floor(y * 842 / CAST(10 AS DOUBLE) + 0.5) / CAST(100 AS DOUBLE) AS y, floor(w * 595 / CAST(10 AS DOUBLE) + 0.5) / CAST(100 AS DOUBLE) AS w, floor(h * 842 / CAST(10 AS DOUBLE) + 0.5) / CAST(100 AS DOUBLE) AS h FROM {rects}")
same("g07_text_rect", "SELECT page, id, x, round(y - h * 0.88, 6) AS y, x + w AS x1, round(y + h * 0.12, 6) AS y1 FROM {rects}")
same("g08_normalized_rect", "SELECT page, id, round(x / CAST(600 AS DOUBLE) * 595, 6) AS x, round((1 - (y + h) / 1200.0) * 842, 6) AS y FROM {rects}")
same("g09_geometry_gate", "SELECT page, id, CASE WHEN x < 0 OR y <= 0 OR x + w > 600 OR y + h > 1000 THEN 'page-edge-touch' WHEN w * h / (600.0 * 1000) > 0.9 OR h / 1000.0 > 0.94 OR w * h / (600.0 * 1000) > 0.5 THEN 'page-coverage-excessive' END AS issue FROM {rects}")
same("g12_nested", f"SELECT a.page, a.id FROM {{rects}} a WHERE NOT EXISTS (SELECT 1 FROM {{rects}} b WHERE a.page = b.page AND a.id <> b.id AND {AREA} >= 0.75 * a.w * a.h)")
same("g18_footer_overflow", "SELECT page, id, y + h - 800 AS overflow FROM {rects} WHERE y + h > 800")
same("g19_bounded_width", "SELECT page, id, least(w, CASE WHEN w > 300 THEN 500 ELSE 240 END) AS width, h > 2 * w AS stacked FROM {rects}")
same("h16_column", "SELECT page, id, CASE WHEN w >= 0.55 * 600 THEN 'span' WHEN x + w / 2 < 300 THEN 'left' ELSE 'right' END AS col FROM {rects}")
same("t32_column_class", "SELECT page, id, CASE WHEN w > 0.6 * 600 THEN 'full' WHEN x + w / 2 <= 300 THEN 'left' ELSE 'right' END AS col FROM {rects}")
same("t33_layout_mode", "SELECT page, CASE WHEN lefts = 0 OR rights = 0 THEN 'single' WHEN fulls = 0 THEN 'double' ELSE 'mixed' END AS mode FROM (SELECT page, count(*) FILTER (WHERE w <= 150 AND x + w / 2 <= 300) AS lefts, count(*) FILTER (WHERE w <= 150 AND x + w / 2 > 300) AS rights, count(*) FILTER (WHERE w > 150) AS fulls FROM {rects} GROUP BY page) q")
same("a19_merge_geometry", "SELECT page, count(*) AS rects, round(sum(w * h), 4) AS area FROM {rects} GROUP BY page")
same("k16_reader_boxes", "SELECT s.page AS source_page, t.page AS target_page, min(s.x) AS x, min(s.y) AS y, max(t.x + t.w) AS x1, max(t.y + t.h) AS y1 FROM {rects} s JOIN {rects} t ON s.page = t.page AND s.kind <> t.kind GROUP BY s.page, t.page")
same("h37_portrait_clusters", "SELECT page, count(*) AS portraits FROM {rects} WHERE h / greatest(w, 1e-9) BETWEEN 1.05 AND 3 GROUP BY page HAVING count(*) >= 2")

# -- gates ----------------------------------------------------------------------------------------------------------

same("v04_alignment_gate", """SELECT l_orderkey, l_linenumber, 'unit-unmatched' AS code, 'error' AS severity FROM {lineitem} WHERE l_discount <= 0 UNION ALL SELECT l_orderkey, l_linenumber, 'unit-low-confidence', 'warn' FROM {lineitem} WHERE l_discount > 0 AND l_discount < 0.02
    UNION ALL SELECT l_orderkey, l_linenumber, 'paragraph-fallback', 'warn' FROM {lineitem} WHERE l_returnflag = 'R'""")
same("v05_composition_gate", "SELECT o.o_orderkey, CASE WHEN count(l.l_orderkey) = 0 THEN 'unit-missing' WHEN max(l.l_linenumber) <> count(l.l_orderkey) THEN 'order-changed' ELSE 'ok' END AS code FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey")
same("v06_content_gate", "SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'empty-page' WHEN text LIKE '%<%>%' THEN 'markup' WHEN n_chars <> length(text) THEN 'length' ELSE 'ok' END AS code FROM {documents}")
same("v07_structure", "SELECT 'duplicate-line' AS code, doc_id, count(*) AS n FROM {lines} WHERE length(line) > 0 GROUP BY doc_id, line HAVING count(*) > 1 UNION ALL SELECT 'blank-line', doc_id, count(*) FROM {lines} WHERE length(trim(line)) = 0 GROUP BY doc_id")
same("v08_marker_gates", "SELECT conv_id, role, count(*) AS n FROM {conversations} GROUP BY conv_id, role HAVING count(*) > 1")
same("v09_plan_codes", "SELECT page, id, CASE WHEN w <= 0 OR h <= 0 THEN 'bad-box' WHEN x + w > 1000 OR y + h > 1000 THEN 'out-of-page' WHEN score < 0.01 THEN 'low-confidence' END AS code FROM {rects}")
same("v11_progress", "SELECT count(*) FILTER (WHERE b.doc_id IS NULL) AS resolved, count(*) FILTER (WHERE b.doc_id IS NULL) > 0 AS progress FROM (SELECT doc_id FROM {labels} WHERE quality = 0) a LEFT JOIN (SELECT doc_id FROM {labels} WHERE toxic = 1) b ON a.doc_id = b.doc_id")
same("v12_local_rejection", "SELECT page, id FROM {rects} r WHERE NOT EXISTS (SELECT 1 FROM {rects} o WHERE o.page = r.page AND o.kind = 'R' AND o.id = r.id)")
same("v13_unresolved_issues", "SELECT r.page, r.id, CASE WHEN r.kind = 'A' THEN 'geometry' WHEN r.kind = 'N' THEN 'caption' ELSE 'other' END AS issue FROM {rects} r JOIN {orders} o ON o.o_orderkey = r.page AND o.o_orderstatus = 'O'")
same("v18_persist_gate", "SELECT o_orderkey, o_orderstatus <> 'P' AND (o_orderpriority = '1-URGENT' OR o_totalprice > 1000) AS persist FROM {orders}")

# -- stores ---------------------------------------------------------------------------------------------------------

same("c05_import_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM {documents} WHERE text NOT IN (SELECT text FROM {benchmark}) GROUP BY text")
same("c06_export_current", "SELECT d.doc_id, l.quality FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id AND d.n_chars = length(d.text)")
same("c14_store_scan", "SELECT o_orderkey, o_custkey, o_orderdate FROM {orders}")
same("c15_repository_list", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM {orders}")
same("c16_cascade_delete", "SELECT doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
same("c17_project_records", "SELECT source, lang, doc_id FROM {documents} WHERE lang IS NOT NULL")
same("h43_revision_check", "SELECT o_orderkey, o_orderkey % 3 = o_custkey % 3 AS current FROM {orders}")
same("h48_asset_verification", "SELECT doc_id, n_chars = length(text) AS verified FROM {documents}")

# -- events as states -----------------------------------------------------------------------------------------------

same("s03_recover", "SELECT user_id, CASE WHEN last IN ('click', 'view') THEN 'paused' ELSE last END AS stage FROM (SELECT user_id, event_type AS last, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) q WHERE r = 1")
same("s02_job_progress", """SELECT event_id, max(CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 40 WHEN 'purchase' THEN 100 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM {events}""")
same("s08_progress", "SELECT event_id, least(100, greatest(0, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))) AS done FROM {events}")
same("s09_resumable", "SELECT d.doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)")
same("s10_event_types", "SELECT event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM {events} GROUP BY event_type")
same("s11_poll_diff", "SELECT event_id, event_type = 'purchase' AND coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') <> 'purchase' AS finished FROM {events}")
