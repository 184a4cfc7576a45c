import hashlib
import random

import corpus_pipeline as P
from lectern.llm import line_dedup, mixing
from lectern.session import durable

WORDS = {"aa": "the of and thing ing tion".split(), "bb": "der und ich keit ung sch".split()}


def test_stages_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        lang = "ab"[i % 2] * 2
        text = "\n".join(" ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(12)) + "." for _ in range(5))
        rows.append((i, text + "\nThis very line is in all of the documents.", lang, f"src{i % 4}", len(text)))
    rows += [(60, rows[3][1], "bb", "src0", 1), (61, "12 34", "aa", "src1", 5), (62, None, None, None, None), (63, "", "aa", "src1", 0), (3, rows[3][1], "bb", "src3", 1), (64, rows[5][1].replace("\n", " ", 1), "bb", "src1", 1), (70, "the thing and the thing of ingtion and oftion\nThis very line is in all of the documents.", "aa", "src2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    named = dict(P.STAGES)

    langs = durable(named["language_id"](spark, docs, ""))
    assert langs.columns == list(P.COLUMNS)
    kept = langs.collect()
    assert sorted(r.doc_id for r in kept) == sorted(r[0] for r in rows if r[1] and r[0] != 61)
    assert sum(r.lang == dict((x[0], x[2]) for x in rows)[r.doc_id] for r in kept) >= len(kept) - 1

    lines = durable(named["line_dedup"](spark, langs, ""))
    want = line_dedup.brute_force([(r.doc_id, r.text) for r in kept])
    got = lines.select("doc_id", line_dedup.sha256_hex("text").alias("h")).collect()
    gone = hashlib.sha256(b"").hexdigest()  # a document of which nothing is left goes
    assert sorted(map(tuple, got)) == sorted((w[0], w[3]) for w in want if w[3] != gone)

    near = durable(named["simhash"](spark, lines, ""))
    ids = [r.doc_id for r in near.collect()]
    assert len(set(ids)) == len(ids) and set(ids) == {r.doc_id for r in lines.collect()} - {60, 64}  # copies of 3 and of 5

    text = rows[0][1]
    odd = [(None, text, "aa", "s", 1), (0, text, "bb", "s", 1), (0, text, None, "t", 1), (1, rows[1][1], "aa", "s", 1), (1, text + "\n", "aa", "s", 1), (None, rows[5][1], "aa", "s", 1), (None, rows[5][1], "aa", "r", 1), (None, rows[7][1], "aa", None, None)]
    odd = spark.createDataFrame(odd, docs.schema)
    got = {(r.doc_id, r.text, r.lang, r.source) for r in named["simhash"](spark, odd, "").collect()}
    assert got == {(0, text, None, "t"), (1, rows[1][1], "aa", "s"), (None, rows[5][1], "aa", "r"), (None, rows[7][1], "aa", None)}

    mixed = durable(named["mixing"](spark, near, ""))
    by = {r.doc_id: r for r in near.collect()}
    flat = [{"id": str(i), "path": (f"d{int(r.source[3:]) % 4}", r.lang, r.source), "n": len(r.text.split())} for i, r in by.items()]
    chosen = mixing.brute_force(flat, mixing.DEFAULT_WEIGHTS, 0.8, 2, 42)
    assert sorted(str(r.doc_id) for r in mixed.collect()) == sorted(c[0] for c in chosen)

    pieces = named["packing"](spark, mixed, "").collect()
    assert sum(len(p.ids) // 4 for p in pieces) == sum({(p.doc_id, p.doc_tokens, p.sequence_id * 2048 + p.offset - p.start): p.doc_tokens for p in pieces}.values())
    empty = docs.where("false")
    for name, stage in P.STAGES:
        assert stage(spark, empty, "").isEmpty(), name
