"""Queries of the order-dependent operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grouped as G
from .registry import Tables, query


def turn_pairs(t: Tables):
    """A row a conversation: sentences of the user's and of the assistant's turns."""
    c = t.conversations.select("conv_id", "turn", "role", F.explode(T.sentences(F.col("text"))).alias("s"))
    return c.where(F.col("role").isin("user", "assistant"))


def _sides(pdf):
    return pdf.s[pdf.role == "user"].tolist(), pdf.s[pdf.role == "assistant"].tolist()


@query("k07_sentence_dp")
def k07(t: Tables):
    def work(pdf):
        left, right = _sides(pdf)
        return [(i, a, b, c) for i, (a, b, c) in enumerate(G.align(len(left), len(right), lambda i, j: G.overlap_score(left[i], right[j])))]

    return G.per_group(turn_pairs(t), ["conv_id"], ["turn"], work, "unit long, en array<long>, zh array<long>, confidence double")


@query("k10_block_pairs")
def k10(t: Tables):
    def work(pdf):
        level, units = G.align_blocks(*_sides(pdf))
        return [(level, len(units), G.mean_confidence(units))]

    return G.per_group(turn_pairs(t), ["conv_id"], ["turn"], work, "level string, units long, confidence double")


@query("k09_anchored_blocks")
def k09(t: Tables):
    def work(pdf):
        sides = [[(str(n) if n % 3 == 0 else None, x) for n, x in enumerate(pdf.text[pdf.role == r])] for r in ("user", "assistant")]
        return [(i, a, b, c) for i, (a, b, c) in enumerate(G.anchored(*sides))]

    return G.per_group(t.conversations, ["conv_id"], ["turn"], work, "unit long, en array<long>, zh array<long>, confidence double")


@query("k08_block_dp")
def k08(t: Tables):
    def work(pdf):
        left, right = (pdf.text[pdf.role == r].fillna("").tolist() for r in ("user", "assistant"))
        units = G.align(len(left), len(right), lambda i, j: G.overlap_score(left[i], right[j]), 0.8)
        return [(i, a, b, c) for i, (a, b, c) in enumerate(units)]

    return G.per_group(t.conversations, ["conv_id"], ["turn"], work, "unit long, en array<long>, zh array<long>, confidence double")


@query("k20_batches")
def k20(t: Tables):
    """Lines of a document in batches of at most 4000 tokens and 8 blocks."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", T.estimate_tokens(F.col("line")).alias("tokens"))
    return G.per_group(lines, ["doc_id"], ["pos"], lambda pdf: [(int(p), *b) for p, b in zip(pdf.pos, G.batches([int(x) for x in pdf.tokens], 20), strict=True)], "pos long, batch long, tokens long, oversized boolean")


@query("k21_split_batch", "SELECT doc_id, n // 2 AS first_half, n - n // 2 AS second_half FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)")
def k21(t: Tables):
    n = F.size(F.split("text", "\n")).cast("long")
    return t.documents.select("doc_id", F.floor(n / 2).alias("first_half"), (n - F.floor(n / 2)).alias("second_half"))


@query("k18_pagination")
def k18(t: Tables):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", (F.ceil(F.length("line") / 60) * 14.0 + 6).alias("height"))
    return G.per_group(lines, ["doc_id"], ["pos"], lambda pdf: [(int(p), *x) for p, x in zip(pdf.pos, G.paginate(pdf.height.tolist()), strict=True)], "pos long, page long, col long, y double")


@query("k25_approximate_range")
def k25(t: Tables):
    """Where a document's words come closest to its own tenth to twentieth word with one of them changed."""
    rows = t.documents.select("doc_id", T.word_tokens(F.col("text")).alias("words"))

    def work(words):
        found = G.approximate_range(words, [*words[9:14], "changed", *words[15:20]])
        return [found] if found else []

    return G.per_row(rows, ["doc_id"], work, "first long, end long, confidence double")


@query("j12_cursor_matches")
def j12(t: Tables):
    rows = t.documents.select("doc_id", T.whole(F.col("text")).alias("text"), T.sentences(F.col("text")).alias("s"))
    return G.per_row(rows, ["doc_id"], lambda text, s: [(i, *m) for i, m in enumerate(G.cursor_matches(text, s))], "sentence long, start long, end long, found boolean")


@query("j21_adjacent_pages")
def j21(t: Tables):
    """Rectangles of a page's end linked to the next page's start of the same kind, one to one, heaviest first."""
    r = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", F.expr("l_partkey * 1000 + l_suppkey AS id"))
    a, b = r.alias("a"), r.alias("b")
    links = a.join(b, F.expr("a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_returnflag = b.l_returnflag")).select("a.l_orderkey", F.col("a.id").alias("l"), F.col("b.id").alias("r"), (F.col("a.l_quantity") + F.col("b.l_quantity")).alias("score"))
    links = links.withColumn("rank", -F.col("score"))
    return G.per_group(links, ["l_orderkey"], ["rank", "l", "r"], lambda pdf: G.one_to_one(list(zip(pdf.l, pdf.r, pdf.score, strict=True))), "l long, r long, score double")


@query("l08_greedy_matching")
def l08(t: Tables):
    """Questions and answers of a conversation matched one to one, most shared words first."""

    def work(pdf):
        users, answers = ([(int(k), x) for k, x in zip(pdf.turn[pdf.role == r], pdf.text[pdf.role == r], strict=True)] for r in ("user", "assistant"))
        links = sorted(((u, a, G.overlap_score(x, y)) for u, x in users for a, y in answers), key=lambda z: (-z[2], z[0], z[1]))
        return G.one_to_one(links)

    return G.per_group(t.conversations, ["conv_id"], ["turn"], work, "question long, answer long, score double")


def texts(t: Tables):
    return t.documents.select("doc_id", T.whole(F.col("text")).alias("text"))


@query("t14_mask_restore")
def t14(t: Tables):
    """Numbers masked by markers, and whether restoring gives the text again."""
    pattern = r"\[\s*(?:\d+(?:\s*[-,]\s*\d+)*)\s*\]|(?<![A-Za-z0-9])[-+]?(?:\d+\.\d+|\d+)(?:%|‰)?"

    def work(text):
        masked, found = G.mask_tokens(text, pattern, 0)
        return [(masked, len(found), G.restore_tokens(masked, found) == text)]

    return G.per_row(texts(t), ["doc_id"], work, "masked string, tokens long, restored boolean")


@query("t55_split_oversized")
def t55(t: Tables):
    return G.per_row(texts(t), ["doc_id"], lambda text: list(enumerate(G.cut_text(text))), "piece long, body string")


@query("t56_repair_chunks")
def t56(t: Tables):
    return G.per_row(texts(t), ["doc_id"], lambda text: list(enumerate(G.cut_text(text, 340, 120 / 340, r"(?<=[.!?;,。！？；，])\s|\n"))), "piece long, body string")


@query("t57_chunk_by_height")
def t57(t: Tables):
    """Pieces that fit a box of 20 lines of 60 characters."""
    return G.per_row(texts(t), ["doc_id"], lambda text: list(enumerate(G.cut_text(text, 1200, 0.5, r"\s"))), "piece long, body string")


@query("t49_first_json")
def t49(t: Tables):
    rows = t.events.select("event_id", F.concat(F.lit("Here it is: ```json\n"), T.whole(F.col("props")), F.lit("\n``` done }")).alias("raw"))
    return G.per_row(rows, ["event_id"], lambda raw: [(G.first_json(raw),)], "doc string")


def boxes(t: Tables):
    return t.lineitem.selectExpr("l_orderkey AS page", "l_linenumber * 1000000000L + l_partkey * 1000 + l_suppkey AS id", "double(l_partkey % 600) AS x", "double(l_suppkey * 7 % 800) AS y", "l_quantity * 4 AS w", "l_linenumber * 40.0D AS h", "l_returnflag = 'A' AS captioned", "l_returnflag AS kind")


BOX = ["x", "y", "w", "h"]


def rows_of_words(x, y, h, kind):
    return list(enumerate(G.text_rows(list(zip(x, y, h, kind, strict=True)))))


@query("g03_merge_boxes")
def g03(t: Tables):
    return G.per_lists(boxes(t), ["page"], ["id"], BOX, lambda *box: G.merge_boxes(list(zip(*box, strict=True))), "x double, y double, w double, h double")


@query("g11_dedup_regions")
def g11(t: Tables):
    return G.per_lists(boxes(t), ["page"], ["id"], ["id", "captioned", *BOX], lambda ids, captioned, *box: [(ids[k],) for k in G.dedup_boxes(list(zip(zip(*box, strict=True), captioned, strict=True)))], "id long")


@query("w12_text_rows")
def w12(t: Tables):
    return G.per_lists(boxes(t), ["page"], ["id"], ["x", "y", "h", "kind"], rows_of_words, "row long, body string")


@query("w14_bibliography_rows")
def w14(t: Tables):
    """Rows of each column of a page."""
    cols = boxes(t).withColumn("col", F.when(F.col("x") >= 290, 1).otherwise(0))
    return G.per_lists(cols, ["page", "col"], ["id"], ["x", "y", "h", "kind"], rows_of_words, "row long, body string")


JOB = ("click", "START", "view", "PARSED", "purchase", "INDEXED", "error", "FAIL", "login", "RESUME", "logout", "PAUSE", "signup", "RETRY")


@query("s01_task_fold")
def s01(t: Tables):
    """Events as task events: each event's place in the list of names is its number modulo their count."""
    names = [*G.TASK_EVENTS, "BLOCKS_VALIDATED"]
    rows = t.events.withColumn("name", F.element_at(F.array(*map(F.lit, names)), (F.pmod("event_id", F.lit(len(names))) + 1).cast("int")))
    return G.per_group(rows, ["user_id"], ["ts", "event_id"], lambda pdf: [(int(i), *s) for i, s in zip(pdf.event_id, G.fold_task(list(zip(pdf.name, (pdf.event_id % 5).tolist(), strict=True))), strict=True)], "event_id long, stage string, status string, completed long, total long, legal boolean")


@query("s02_job_fold")
def s02(t: Tables):
    rows = t.events.withColumn("name", F.coalesce(F.element_at(F.create_map(*map(F.lit, JOB)), F.col("event_type")), F.lit("ANALYZED")))
    return G.per_group(rows, ["user_id"], ["ts", "event_id"], lambda pdf: [(int(i), *s) for i, s in zip(pdf.event_id, G.fold_job(pdf.name.tolist()), strict=True)], "event_id long, stage string, progress long, attempts long")


@query("s06_throttle")
def s06(t: Tables):
    return G.per_group(t.events, ["user_id"], ["ts", "event_id"], lambda pdf: [(int(i), bool(k)) for i, k in zip(pdf.event_id, G.throttle(list(zip(pdf.event_type, pdf.ts.astype("int64") / 1e9, strict=True)), 600.0), strict=True)], "event_id long, kept boolean")


@query("s07_sync_lock")
def s07(t: Tables):
    """A side's command locks that side for 150 ms."""
    return G.per_group(t.events, ["user_id"], ["ts", "event_id"], lambda pdf: [(int(i), bool(k)) for i, k in zip(pdf.event_id, G.throttle(list(zip((pdf.event_id % 2).astype(str), pdf.ts.astype("int64") / 1e9, strict=True)), 0.15), strict=True)], "event_id long, allowed boolean")
