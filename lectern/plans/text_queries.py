"""Queries of the text functions, over ``documents``, ``pages``, ``conversations`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import Tables, query

NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
TITLE = "string_split({0}, chr(10))[1]"


def norm(x: str) -> str:
    return NORM.format(x)


def title(c: str = "text"):
    return F.split(F.col(c), "\n")[0]


def joined(c):
    return F.array_join(c, "|")


TOKENS = f"regexp_extract_all({norm('text')}, '[a-z0-9]+|[\\x{{3400}}-\\x{{9fff}}]+')"


@query("t01_normalize", f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def t01(t: Tables):
    return t.documents.select("doc_id", T.normalize(F.col("text")).alias("norm"))


@query("t02_tokens_v3", f"SELECT doc_id, len({TOKENS}) AS n, array_to_string({TOKENS}, '|') AS tokens FROM documents")
def t02(t: Tables):
    tokens = T.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(tokens).cast("long").alias("n"), joined(tokens).alias("tokens"))


@query("t03_tokens_v1", """
    WITH raw AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.-][a-z0-9]+)*|[\\x{3400}-\\x{9fff}]+')) AS tok FROM documents)
    SELECT d.doc_id, count(DISTINCT tok) AS n FROM documents d LEFT JOIN raw USING (doc_id) GROUP BY d.doc_id""")
def t03(t: Tables):
    return t.documents.select("doc_id", F.size(T.technical_tokens(F.col("text"))).cast("long").alias("n"))


PLAIN = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\x{{3400}}-\\x{{9fff}}]+', ' ', 'g'))"


@query("t04_related_tokens", f"SELECT doc_id, array_to_string(list_filter(string_split({PLAIN.format('text')}, ' '), lambda x: length(x) > 1), '|') AS tokens FROM documents")
def t04(t: Tables):
    return t.documents.select("doc_id", joined(T.related_tokens(F.col("text"))).alias("tokens"))


@query("t05_title_tokens", f"SELECT doc_id, len(list_distinct(list_filter(string_split({PLAIN.format(TITLE.format('text'))}, ' '), lambda x: length(x) > 1))) AS n FROM documents")
def t05(t: Tables):
    return t.documents.select("doc_id", F.size(T.title_tokens(title())).cast("long").alias("n"))


@query("t06_normalize_title_doi", f"SELECT page_id, {PLAIN.format('url')} AS title, lower(trim(regexp_replace('https://doi.org/10.1000/' || url, '^https?://(?:dx\\.)?doi\\.org/', '', 'i'))) AS doi FROM pages")
def t06(t: Tables):
    return t.pages.select("page_id", T.normalize_title(F.col("url")).alias("title"), T.normalize_doi(F.concat(F.lit("https://doi.org/10.1000/"), "url")).alias("doi"))


@query("t07_compact", "SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS compact FROM documents")
def t07(t: Tables):
    return t.documents.select("doc_id", T.compact(F.col("text")).alias("compact"))


@query("t09_contains_term", "SELECT doc_id, regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}_])the(?:$|[^\\p{L}\\p{N}_])') AS has_the, regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}_])under the(?:$|[^\\p{L}\\p{N}_])') AS has_phrase FROM documents")
def t09(t: Tables):
    return t.documents.select("doc_id", T.contains_term(F.col("text"), F.lit("The ")).alias("has_the"), T.contains_term(F.col("text"), F.lit("under the")).alias("has_phrase"))


@query("t10_regex_escape", "SELECT page_id, regexp_replace(url, '([.*+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g') AS escaped FROM pages")
def t10(t: Tables):
    return t.pages.select("page_id", T.regex_escape(F.col("url")).alias("escaped"))


@query("t11_sentences", """
    WITH u AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '((?i)https?://[^\\s<>"）)]*[^\\s<>"）).!?;。！？；])', chr(2) || '\\1' || chr(3), 'g'), chr(2)), lambda x: CASE WHEN contains(x, chr(3)) THEN replace(string_split(x, chr(3))[1], '.', chr(1)) || string_split(x, chr(3))[2] ELSE x END) AS parts FROM documents),
    p AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(parts, ''), '(?i)(Figs|Fig|Eqs|Eq|et al)\\.', '\\1' || chr(1), 'g'), '(?i)(e)\\.(g)\\.', '\\1' || chr(1) || '\\2' || chr(1), 'g'), '(?i)(i)\\.(e)\\.', '\\1' || chr(1) || '\\2' || chr(1), 'g'), '(\\d)\\.(\\d)', '\\1' || chr(1) || '\\2', 'g') AS s FROM u),
    q AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(s, '[^。！？!?;；.．\\n]*[。！？!?;；.．]|[^。！？!?;；.．\\n]+'), lambda x: regexp_replace(replace(x, chr(1), '.'), '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0) AS s FROM p)
    SELECT doc_id, len(s) AS n, array_to_string(s, '|') AS sentences FROM q""")
def t11(t: Tables):
    some = T.sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(some).cast("long").alias("n"), joined(some).alias("sentences"))


@query("t12_sentence_candidates")
def t12(t: Tables):
    """Sentences with ids, or the paragraph where they don't make up the text again."""
    bare = F.regexp_replace("text", r"\s+", "")
    odd = F.col("text").rlike("[_=]") & F.col("text").rlike("[:;]")

    def choice(some):
        whole = F.regexp_replace(F.array_join(some, ""), r"\s+", "") == bare
        return F.when(whole & ~odd, some).otherwise(F.array(F.trim("text")))

    once = F.transform(F.array(T.sentences(F.col("text"))), choice)[0]  # bound as one element: sentences are cut once
    rows = t.documents.select("doc_id", once.alias("s"))
    each = rows.select("doc_id", F.posexplode_outer("s").alias("i", "sentence")).where("i IS NOT NULL")  # of the inner form the planner makes a filter that cuts the sentences again
    return each.select("doc_id", F.concat("doc_id", F.lit("-s-"), F.col("i") + 1).alias("sentence_id"), "sentence")


@query("t13_protected_tokens", "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?:^|[^A-Za-z0-9.])(\\[\\s*\\d+(?:\\s*[-,]\\s*\\d+)*\\s*\\])', 1), lambda x: x), '|') AS cited FROM documents")
def t13(t: Tables):
    cited = F.filter(T.protected_tokens(F.col("text")), lambda x: x.rlike(T.CITATION))
    return t.documents.select("doc_id", joined(cited).alias("cited"))


@query("t16_occurrences", "SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INTEGER) AS n_the FROM documents")
def t16(t: Tables):
    return t.documents.select("doc_id", T.occurrences(F.col("text"), F.lit("the")).alias("n_the"))


@query("t17_protected_occurrences")
def t17(t: Tables):
    text = F.concat("text", F.lit(" [1, 2] and [1,2], 3.5% of 3"))
    return t.documents.select("doc_id", *[T.protected_occurrences(text, F.lit(x)).alias(n) for n, x in (("cited", "[1,2]"), ("percent", "3.5%"), ("number", "3"), ("word", "and"))])


@query("t19_needs_translation", f"""
    SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+(?:[''’-][A-Za-z]+)*')) >= 5 AND NOT regexp_matches(text, '[\\x{{3400}}-\\x{{9fff}}]')
        AND len(list_intersect(list_transform(regexp_extract_all(text, '[A-Za-z]+(?:[''’-][A-Za-z]+)*'), lambda x: lower(x)), string_split('{' '.join(T.FUNCTION_WORDS)}', ' '))) > 0 AS needed FROM documents""")
def t19(t: Tables):
    return t.documents.select("doc_id", T.needs_translation(F.col("text")).alias("needed"))


@query("t20_residual_words", "SELECT doc_id, len(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(text, '(?i)https?://\\S+|\\b\\S+@\\S+\\b', ' ', 'g'), '[（(][^()（）]{0,240}[）)]', ' ', 'g'), '\\b[a-z]{8,}(?:-[a-z]{4,})*\\b'))) AS n FROM documents")
def t20(t: Tables):
    return t.documents.select("doc_id", F.size(T.residual_words(F.col("text"))).cast("long").alias("n"))


@query("t21_token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 2.5) AS BIGINT) AS tokens FROM documents")
def t21(t: Tables):
    return t.documents.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("t22_term_pairs")
def t22(t: Tables):
    some = T.term_pairs(F.concat("text", F.lit("以及零知识（Zero Knowledge, ZK）和零知识（Zero Knowledge, ZK）与轨迹（Trace log）")))
    return t.documents.select("doc_id", F.explode(some).alias("p")).select("doc_id", "p.*")


@query("t23_structural_numbers", "SELECT doc_id, array_to_string(regexp_extract_all(text, '[+\\-−]?(?:(?:\\d{1,3}(?:,\\d{3})+|\\d+)(?:\\.\\d+)?|\\.\\d+)(?:[eE][+\\-−]?\\d+)?(?:\\s*[×x]\\s*10\\s*\\^\\s*[+\\-−]?\\d+)?'), '|') AS found FROM documents")
def t23(t: Tables):
    return t.documents.select("doc_id", joined(T.structural_numbers(F.col("text"))).alias("found"))


@query("t24_numbers", "SELECT doc_id, len(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')) AS n, round(coalesce(list_sum(list_transform(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), lambda x: log10(1 + CAST(x AS DOUBLE)))), 0), 6) AS logs FROM documents")
def t24(t: Tables):
    found = T.numbers(F.col("text"))
    logs = F.aggregate(found, F.lit(0.0), lambda a, x: a + F.log10(x + 1))
    return t.documents.select("doc_id", F.size(found).cast("long").alias("n"), F.round(logs, 6).alias("logs"))


LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"


def lines(t: Tables):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


@query("t25_labels", f"SELECT doc_id, pos, nullif(regexp_extract(trim(line), '^\\s*(\\d+(?:\\.\\d+)*)\\s', 1), '') AS section, CASE WHEN regexp_matches(trim(line), '^\\(\\d+\\)\\s*$') THEN 'eq' || regexp_extract(trim(line), '^\\((\\d+)\\)', 1) END AS equation FROM {LINES}")
def t25(t: Tables):
    label = T.numbered_label(F.col("line"))
    return lines(t).select("doc_id", "pos", T.section_number(F.col("line")).alias("section"), F.when(label.startswith("eq"), label).alias("equation"))


@query("t26_anchor_labels", f"SELECT doc_id, pos, CASE WHEN regexp_matches(trim(line), '(?i)^abstract') THEN 'abstract' WHEN regexp_matches(trim(line), '^\\s*\\d+(?:\\.\\d+)*\\s') THEN 'sec' || regexp_extract(trim(line), '^\\s*(\\d+(?:\\.\\d+)*)\\s', 1) END AS label FROM {LINES}")
def t26(t: Tables):
    return lines(t).select("doc_id", "pos", T.anchor_label(F.lit("section"), F.col("line")).alias("label"))


TOPIC_SQL = " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{n}'" for n, p in T.TOPICS)


@query("t34_topic", f"SELECT doc_id, CASE {TOPIC_SQL} ELSE '{T.OTHER_TOPIC}' END AS topic FROM documents")
def t34(t: Tables):
    return t.documents.select("doc_id", T.topic(F.col("text")).alias("topic"))


@query("t35_focus_terms", f"""
    WITH c AS (SELECT doc_id, list_filter([trim(source), trim(lang), trim(upper(lang)), 'Design', trim({TITLE.format('text')})], lambda x: length(x) > 0 AND lower(x) NOT IN ('design')) AS terms FROM documents)
    SELECT doc_id, array_to_string(list_filter(terms, lambda x, i: list_position(list_transform(terms, lambda y: lower(y)), lower(x)) = i)[1:3], '|') AS first_three FROM c""")
def t35(t: Tables):
    some = F.array("source", "lang", F.upper("lang"), F.lit("Design"), title())
    return t.documents.select("doc_id", joined(T.focus_terms(some)).alias("first_three"))


@query("h44_topic_label", f"SELECT doc_id, (CASE {TOPIC_SQL} ELSE '{T.OTHER_TOPIC}' END) || ' · ' || source AS label FROM documents")
def h44(t: Tables):
    return t.documents.select("doc_id", F.concat_ws(" · ", T.topic(F.col("text")), T.focus_terms(F.array("source"))[0]).alias("label"))


@query("t42_canonical_json", "SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS doc FROM events")
def t42(t: Tables):
    return t.events.select("event_id", T.canonical_json({"user_id": F.col("user_id"), "event_type": F.col("event_type")}).alias("doc"))


@query("t43_cache_key_v3", "SELECT doc_id, sha256('[\"' || source || '\",\"' || lang || '\",\"' || sha256(text) || '\"]') AS cache_key FROM documents")
def t43(t: Tables):
    return t.documents.select("doc_id", F.sha2(F.to_json(F.array("source", "lang", F.sha2("text", 256))), 256).alias("cache_key"))


@query("t44_cache_key_parts", "SELECT page_id, 'translation-cache-v2:' || replace(replace(replace(replace(replace(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D'), '&', '%26'), '#', '%23'), ' ', '%20') AS cache_key FROM pages")
def t44(t: Tables):
    return t.pages.select("page_id", T.cache_key(F.lit("translation-cache-v2"), F.col("url")).alias("cache_key"))


@query("t45_fnv1a")
def t45(t: Tables):
    return t.pages.select("page_id", T.fnv1a(F.col("url")).alias("h"))


@query("t51_redact", """
    SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_-]+', '[redacted]', 'g'), '(?i)(Authorization\\s*[:=]\\s*)(?:Bearer\\s+)?[^\\s,;]+', '\\1[redacted]', 'g'), '(?i)\\bBearer\\s+[^\\s,;]+', 'Bearer [redacted]', 'g'), 300) AS message FROM documents""")
def t51(t: Tables):
    return t.documents.select("doc_id", T.redact(F.col("text")).alias("message"))


@query("t52_html_escape", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def t52(t: Tables):
    return t.pages.select("page_id", T.html_escape(F.col("html")).alias("escaped"))


@query("t53_clamp", "SELECT event_id, greatest(10.0, least(90.0, value)) AS clamped FROM events")
def t53(t: Tables):
    return t.events.select("event_id", T.clamp(F.col("value"), 10.0, 90.0).alias("clamped"))


@query("t54_number_spacing")
def t54(t: Tables):
    return t.documents.select("doc_id", T.number_spacing(F.concat("text", F.lit(" 2 . 08 and 3. 5"))).alias("repaired"))


@query("t58_character_boxes", "SELECT n_nationkey, i AS at, substring(n_name, CAST(i + 1 AS BIGINT), 1) AS ch, round(10 + 100.0 / length(n_name) * i, 6) AS x, round(100.0 / length(n_name), 6) AS w FROM (SELECT *, unnest(range(length(n_name))) AS i FROM nation)")
def t58(t: Tables):
    boxes = T.character_boxes(F.col("n_name"), F.lit(10.0), F.lit(100.0))
    return t.nation.select("n_nationkey", F.explode(boxes).alias("b")).select("n_nationkey", F.col("b.i").cast("long").alias("at"), "b.ch", F.round("b.x", 6).alias("x"), F.round("b.w", 6).alias("w"))


@query("t59_locate_substring", f"SELECT doc_id, CASE WHEN instr(text, 'tion the') > 0 THEN instr(text, 'tion the') - 1 WHEN instr({norm('text')}, 'tion the') > 0 THEN instr({norm('text')}, 'tion the') - 1 ELSE -1 END AS start FROM documents")
def t59(t: Tables):
    raw, low = F.instr("text", "tion the"), F.instr(T.normalize(F.col("text")), F.lit("tion the"))
    return t.documents.select("doc_id", F.when(raw > 0, raw - 1).when(low > 0, low - 1).otherwise(-1).cast("long").alias("start"))


@query("t61_confidence_status", "SELECT event_id, CASE WHEN value / 100 >= 0.9 THEN 'aligned' WHEN value / 100 > 0 THEN 'low-confidence' ELSE 'unmatched' END AS status FROM events")
def t61(t: Tables):
    return t.events.select("event_id", T.confidence_status(F.col("value") / 100).alias("status"))


@query("t62_relation", "SELECT conv_id, CASE WHEN u = 1 AND a = 1 THEN '1:1' WHEN u = 1 THEN '1:n' WHEN a = 1 THEN 'n:1' ELSE 'n:m' END AS relation FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS u, count(*) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id)")
def t62(t: Tables):
    counts = t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"))
    return counts.select("conv_id", T.relation(F.col("u"), F.col("a")).alias("relation"))


@query("t63_analysis_packet", """
    WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents),
    q AS (SELECT doc_id, len(pages) AS n, unnest(pages) AS page, unnest(range(len(pages))) AS i FROM p),
    r AS (SELECT doc_id, i, '--- PAGE ' || (i + 1) || ' ---' || chr(10) || left(page, greatest(0, CAST(CASE WHEN i = 0 OR i = n - 1 THEN 720 ELSE greatest(180, floor((2400 - CASE WHEN n > 1 THEN 1440 ELSE 720 END) / (n - 2))) END AS BIGINT) - 20)) AS block FROM q)
    SELECT doc_id, left(string_agg(block, chr(10) || chr(10) ORDER BY i), 2400) AS packet FROM r GROUP BY doc_id""")
def t63(t: Tables):
    return t.documents.select("doc_id", T.packet(F.split("text", "\n"), 2400).alias("packet"))


@query("t67_endpoint", "SELECT page_id, CASE WHEN ends_with(regexp_replace(trim(url), '/+$', ''), '/chat/completions') THEN regexp_replace(trim(url), '/+$', '') ELSE regexp_replace(trim(url), '/+$', '') || '/chat/completions' END AS address FROM pages")
def t67(t: Tables):
    return t.pages.select("page_id", T.endpoint(F.col("url")).alias("address"))


@query("t68_elapsed", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS at, CAST(floor(value / 60) AS BIGINT) || 'm ' || CAST(floor(value % 60) AS BIGINT) || 's' AS elapsed FROM events")
def t68(t: Tables):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), F.concat(F.floor(F.col("value") / 60), F.lit("m "), F.floor(F.col("value") % 60), F.lit("s")).alias("elapsed"))


@query("t69_bad_citations", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\\[(\\d{1,6})\\]', 1), lambda x: CAST(x AS INTEGER)), lambda x: x < 1 OR x > 3))), '|') AS bad FROM documents")
def t69(t: Tables):
    return t.documents.select("doc_id", joined(F.array_sort(T.bad_citations(F.col("text"), F.lit(3)))).alias("bad"))


@query("t70_han_characters", "SELECT doc_id, len(regexp_extract_all(text || '漢字', '\\p{Han}')) AS n FROM documents")
def t70(t: Tables):
    return t.documents.select("doc_id", F.regexp_count(F.concat("text", F.lit("漢字")), F.lit(r"\p{IsHan}")).cast("long").alias("n"))


@query("t71_source_indexes", "SELECT o_orderkey, i AS at, c AS ch FROM (SELECT o_orderkey, unnest(range(length(o_orderpriority))) AS i, unnest(string_split(o_orderpriority, '')) AS c FROM orders) WHERE NOT regexp_matches(c, '\\s')")
def t71(t: Tables):
    """Characters that are no white space, with their places in the source."""
    some = t.orders.select("o_orderkey", F.posexplode(F.split("o_orderpriority", "")).alias("at", "ch"))
    return some.where(F.col("ch").rlike(r"\S")).select("o_orderkey", F.col("at").cast("long").alias("at"), "ch")


@query("t72_word_tokens", "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: regexp_replace(lower(x), '_res$', '')), '|') AS tokens FROM documents")
def t72(t: Tables):
    return t.documents.select("doc_id", joined(T.word_tokens(F.col("text"))).alias("tokens"))


@query("f07_translation_problem", """
    WITH p AS (SELECT a.conv_id, a.turn, trim(coalesce(a.text, '')) AS t, u.text AS s FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant')
    SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '^(翻译说明|注意:)') THEN 'preface' WHEN regexp_matches(t, '(?i:I cannot translate)') THEN 'refusal' WHEN length(trim(s)) >= 20 AND len(regexp_extract_all(t, '[A-Za-z]')) > length(t) * 0.8 THEN 'untranslated' END AS problem FROM p""")
def f07(t: Tables):
    c = t.conversations
    pairs = c.alias("a").where("a.role = 'assistant'").join(c.alias("u"), F.expr("a.conv_id = u.conv_id AND u.turn = a.turn - 1"))
    return pairs.select("a.conv_id", "a.turn", T.translation_problem(F.col("a.text"), F.col("u.text")).alias("problem"))


@query("c10_secret_scan", "SELECT doc_id, regexp_matches(text, '(?i)(api[_-]?key|authorization|secret|password|token)\\s*[:=]|sk-[A-Za-z0-9]{8,}|AKIA[0-9A-Z]{16}') AS secret FROM documents")
def c10(t: Tables):
    return t.documents.select("doc_id", F.col("text").rlike(r"(?i)(api[_-]?key|authorization|secret|password|token)\s*[:=]|sk-[A-Za-z0-9]{8,}|AKIA[0-9A-Z]{16}").alias("secret"))


@query("c02_page_text", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS page_text, length(regexp_replace(text, '\\s', '', 'g')) < 40 AS scanned FROM documents")
def c02(t: Tables):
    return t.documents.select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("page_text"), (F.length(F.regexp_replace("text", r"\s", "")) < 40).alias("scanned"))


@query("c04_fingerprint", "SELECT doc_id, sha256(text) AS sha FROM documents")
def c04(t: Tables):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"))


@query("f16_error_classes", "SELECT event_id, regexp_matches(CAST(400 + event_id % 120 AS VARCHAR), '^(408|409|425|429|5\\d\\d)$') AS retryable, (400 + event_id % 120) IN (401, 402, 403) AS fatal FROM events")
def f16(t: Tables):
    status = (400 + F.col("event_id") % 120).cast("string")
    return t.events.select("event_id", status.rlike(r"^(408|409|425|429|5\d\d)$").alias("retryable"), status.isin("401", "402", "403").alias("fatal"))


@query("h46_http_status", "SELECT event_id, CASE WHEN s IN (401, 403) THEN 'auth' WHEN s = 402 THEN 'balance' WHEN s = 429 THEN 'rate-limit' WHEN s >= 500 THEN 'server' ELSE 'request' END AS code FROM (SELECT event_id, 400 + event_id % 120 AS s FROM events)")
def h46(t: Tables):
    s = 400 + F.col("event_id") % 120
    return t.events.select("event_id", F.when(s.isin(401, 403), "auth").when(s == 402, "balance").when(s == 429, "rate-limit").when(s >= 500, "server").otherwise("request").alias("code"))


@query("h29_insert_token", "SELECT doc_id, regexp_replace(trim(text), '([。！？.!?]?)$', ' ⟦1⟧\\1') AS marked FROM documents")
def h29(t: Tables):
    """A token put before the final mark."""
    return t.documents.select("doc_id", F.regexp_replace(F.trim("text"), r"([。！？.!?]|(?<![。！？.!?]))\z", " ⟦1⟧$1").alias("marked"))


@query("h10_caption_suffix", f"SELECT doc_id, pos, CASE WHEN trim(line) = '' THEN true WHEN regexp_matches(trim(line), '(?i)^[.]\\s+(?:the|this|these|those|it|we|our|a|an)\\b') THEN false WHEN regexp_matches(trim(line), '^[:：.\\-–—]') THEN true ELSE length(ltrim(line)) < length(line) AND regexp_matches(ltrim(line), '^[A-Z]') END AS caption FROM {LINES}")
def h10(t: Tables):
    s = F.ltrim("line")
    rest = F.when(F.trim("line") == "", True).when(F.trim("line").rlike(r"(?i)^[.]\s+(?:the|this|these|those|it|we|our|a|an)\b"), False).when(F.trim("line").rlike(r"^[:：.\-–—]"), True).otherwise((F.length(s) < F.length("line")) & s.rlike("^[A-Z]"))
    return lines(t).select("doc_id", "pos", rest.alias("caption"))


@query("t28_captions", f"SELECT doc_id, bool_or(regexp_matches(trim(line), '(?i)^fig(?:ure)?\\.?\\s*\\d+\\s*[.:：]')) AS figure, bool_or(regexp_matches(trim(line), '(?i)^table\\s*\\d+\\s*[.:：]')) AS tabular FROM {LINES} GROUP BY doc_id")
def t28(t: Tables):
    some = F.split("text", "\n")
    return t.documents.select("doc_id", F.exists(some, lambda x: F.trim(x).rlike(r"(?i)^fig(?:ure)?\.?\s*\d+\s*[.:：]")).alias("figure"), F.exists(some, lambda x: F.trim(x).rlike(r"(?i)^table\s*\d+\s*[.:：]")).alias("tabular"))


@query("t29_formula_score", f"""SELECT doc_id, pos, len(regexp_extract_all(line, '[=≠≈≤≥<>]')) * 2 + len(regexp_extract_all(line, '[+*/^{{}}×÷√∑∫]')) AS score FROM {LINES} WHERE length(line) <= 180""")
def t29(t: Tables):
    score = F.regexp_count("line", F.lit("[=≠≈≤≥<>]")) * 2 + F.regexp_count("line", F.lit("[+*/^{}×÷√∑∫]"))
    return lines(t).where(F.length("line") <= 180).select("doc_id", "pos", score.cast("long").alias("score"))


@query("t64_visual_labels", f"SELECT doc_id, count(*) >= 4 AND count(*) FILTER (WHERE length(trim(line)) <= 32 OR regexp_matches(trim(line), '^[-+]?\\d[\\d.,%‰+\\- ]*$')) >= 0.6 * count(*) AS labels FROM {LINES} WHERE trim(line) <> '' GROUP BY doc_id")
def t64(t: Tables):
    some = lines(t).where(F.trim("line") != "")
    like = (F.length(F.trim("line")) <= 32) | F.trim("line").rlike(r"^[-+]?\d[\d.,%‰+\- ]*$")
    return some.groupBy("doc_id").agg(((F.count(F.lit(1)) >= 4) & (F.count_if(like) >= F.count(F.lit(1)) * 0.6)).alias("labels"))


@query("t30_author_list", f"SELECT doc_id, len(list_filter(string_split(regexp_replace({TITLE.format('text')}, '\\band\\b', ',', 'g'), ','), lambda x: regexp_matches(trim(x), '^[A-Z][A-Za-z''-]+(?:\\s+[A-Z][A-Za-z''-]+)+$'))) >= 3 AS authors FROM documents")
def t30(t: Tables):
    names = F.split(F.regexp_replace(title(), r"\band\b", ","), ",")
    return t.documents.select("doc_id", (F.size(F.filter(names, lambda x: F.trim(x).rlike(r"^[A-Z][A-Za-z'-]+(?:\s+[A-Z][A-Za-z'-]+)+$"))) >= 3).alias("authors"))


@query("t50_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def t50(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("h13_marker_ids", "SELECT conv_id, turn, conv_id || '-g-' || (turn // 2) || '-t-' || (turn % 2) AS marker FROM conversations")
def h13(t: Tables):
    return t.conversations.select("conv_id", "turn", F.concat("conv_id", F.lit("-g-"), F.floor(F.col("turn") / 2), F.lit("-t-"), F.col("turn") % 2).alias("marker"))


@query("h15_zero_based_pages", "SELECT page_id, greatest(0, page_id - 1) AS page_index FROM pages")
def h15(t: Tables):
    return t.pages.select("page_id", F.greatest(F.lit(0), F.col("page_id") - 1).alias("page_index"))
