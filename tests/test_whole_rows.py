import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import graph
from lectern.operators import grouped as G


def test_rows_of_the_same_or_no_id_and_without_text_are_all_read(spark):
    docs = spark.createDataFrame([(1, "a. b"), (1, "b [2] c"), (2, "x"), (None, "y 3.5%"), (3, None), (4, "")], "doc_id long, text string")
    cut = G.per_row(docs, ["doc_id"], lambda text: list(enumerate(G.cut_text(text, 3, 0.5, r"\s"))), "piece long, body string").collect()
    assert sorted((r.doc_id or 0, r.piece, r.body) for r in cut) == sorted([(1, 0, "a. "), (1, 1, "b"), (1, 0, "b "), (1, 1, "[2]"), (1, 2, " c"), (2, 0, "x"), (0, 0, "y "), (0, 1, "3.5"), (0, 2, "%"), (3, 0, ""), (4, 0, "")])
    masked = G.per_row(docs, ["doc_id"], lambda text: [(G.mask_tokens(text, T.PROTECTED, 0)[0],)], "masked string").collect()
    assert len(masked) == 6 and {r.masked for r in masked} >= {"b ⟦PP0_0⟧ c", "y ⟦PP0_0⟧", ""}
    assert G.per_row(docs.where("false"), ["doc_id"], lambda text: [(text,)], "t string").isEmpty()


def test_sentences_with_addresses(spark):
    long = "https://example.org/" + "a.b/" * 300 + "end.html"
    rows = [("See Fig. 1. It is 2.5x. Done!", ["See Fig. 1.", "It is 2.5x.", "Done!"]), (f"At {long}. Then i.e. so; yes", [f"At {long}.", "Then i.e. so;", "yes"]), ("(http://x.y/z.) Hi", ["(http://x.y/z.", ") Hi"]), ("一。二！\n\nthree", ["一。", "二！", "three"]), (None, []), ("", [])]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", T.sentences(F.col("t")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: s for i, (_, s) in enumerate(rows)}


def test_long_chains_and_cycles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(13)] + [(100, 101), (101, 100)], "source long, target long")
    got = sorted((r.head, r.node, r.pos) for r in graph.chains(links).collect())
    assert got == [(0, i, i) for i in range(14)]
    path = links.where("source < 12")
    assert graph.in_cycles(path, most=20).isEmpty()
    with pytest.raises(RuntimeError):
        graph.in_cycles(path, most=3)
    assert sorted(r.id for r in graph.in_cycles(links).collect()) == [100, 101]
    assert graph.chains(links.where("false")).isEmpty()
