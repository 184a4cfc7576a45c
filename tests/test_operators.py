import pytest
from pyspark.sql import functions as F

from lectern.operators import graph, grouped, search, similarity


def ranks(spark, ids, edges, p=None, **how):
    nodes = spark.createDataFrame([(i, float((p or {}).get(i, 0))) for i in ids], "id string, p double")
    table = spark.createDataFrame(edges, "source string, target string, relation string")
    return {r.id: r["rank"] for r in graph.page_rank(nodes, graph.ranked_edges_v3(table), **how).collect()}


def test_page_rank(spark):
    one = ranks(spark, "abc", [("a", "b", "background")], iterations=40)
    assert one["b"] > one["a"] and sum(one.values()) == pytest.approx(1)
    same = ranks(spark, "abc", [("a", "b", "background"), ("b", "c", "similarity")], iterations=40)
    assert same == pytest.approx(one)
    assert ranks(spark, "ab", [("a", "b", "extends")], damping=0.0, iterations=5) == pytest.approx({"a": 0.5, "b": 0.5})


def test_merge_edges(spark):
    rows = [("a", "b", "related", 0.3, 1), ("a", "b", "extends", 1.1, 2), ("a", "b", "background", 0.5, 3), ("a", "c", "extends", 1.1, 4), ("a", "c", "foundation", 1.25, 5)]
    got = {(r.source, r.target): (r.relation, r.weight) for r in graph.merge_edges(spark.createDataFrame(rows, "source string, target string, relation string, weight double, ord int")).collect()}
    assert got == {("a", "b"): ("extends", 1.1), ("a", "c"): ("extends", 1.25)}


def test_cycles_and_chains(spark):
    assert graph.in_cycles(spark.createDataFrame([(1, 2), (2, 3)], "source int, target int")).isEmpty()
    assert {r.id for r in graph.in_cycles(spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "source int, target int")).collect()} == {1, 2}
    got = graph.chains(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "source int, target int")).collect()
    assert sorted((r.head, r.node, r.pos) for r in got) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (7, 7, 0), (7, 8, 1)]


def test_mmr(spark):
    rows = spark.createDataFrame([("a", 1.0, ["d:chiplet", "t:thermal", "t:tsv"]), ("b", 0.98, ["d:chiplet", "t:thermal", "t:tsv"]), ("c", 0.9, ["d:eda", "t:routing"])], "id string, score double, terms array<string>")
    assert [r.id for r in search.mmr(rows, 2, 0.28, 0.72).orderBy("rank").collect()] == ["a", "c"]


def test_bm25_only_hits(spark):
    docs = spark.createDataFrame([(1, "SRAM energy\nbody", "en", "s"), (2, "Quantum optics\nbody", "en", "s")], "doc_id long, text string, lang string, source string")
    papers = search.papers(docs)
    assert [r.doc_id for r in search.bm25(papers, "SRAM").collect()] == [1]
    assert search.bm25(papers, "unmatched").isEmpty() and search.bm25(papers, "!!").isEmpty()


def test_scores(spark):
    row = spark.range(1).select(search.linear_score(*[F.lit(x) for x in (1.0, 0.8, 0.6, 0.4, 0.2)]).alias("a"), search.hybrid_score({"relevance": F.lit(1.0)}, dict.fromkeys(search.SCORE_WEIGHTS, 0.0)).alias("b")).first()
    assert row.a == pytest.approx(0.78) and row.b > 0


def test_pairs(spark):
    sets = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "c", "a"]), (3, ["x"]), (4, [])], "id int, terms array<string>")
    assert [(r.a, r.b, r.score) for r in similarity.jaccard_pairs(sets, 0.5).collect()] == [(1, 2, 1.0)]
    found = similarity.containment_pairs(spark.createDataFrame([(1, "long needle")], "needle int, text string"), spark.createDataFrame([(5, "a long needle here"), (6, "needle long")], "doc int, body string"))
    assert [(r.needle, r.doc, r["at"]) for r in found.collect()] == [(1, 5, 3)]


def test_alignment():
    assert grouped.align(2, 2, lambda i, j: float(i == j)) == [([0], [0], 1.0), ([1], [1], 1.0)]
    assert grouped.align(2, 1, lambda i, j: 0.9)[0][:2] == ([0, 1], [0])
    assert grouped.align(1, 0, lambda i, j: 1.0) == [([0], [], 0.0)]
    assert grouped.approximate_range("a b c d e f".split(), "b c x e f".split())is None
    assert grouped.approximate_range("z a b c d e f g".split(), "a b c d e x g".split())[:2] == (1, 8)
    assert [u[:2] for u in grouped.anchored([("sec1", "x"), (None, "p q")], [(None, "p q"), ("sec1", "x")])][0] == ([], [0])


def test_batches():
    assert grouped.batches([10, 10, 50, 10], 5, 30) == [(1, 25, False), (1, 25, False), (2, 55, True), (3, 15, False)]
    assert [b[0] for b in grouped.batches([1] * 9, 0)] == [1] * 8 + [2]


def test_cutting_and_json():
    assert "".join(grouped.cut_text("One. Two. Three. " * 300, 340)) == "One. Two. Three. " * 300
    for raw in ('{"summary": "a}"}', '```json\n{"summary": 1}\n```', 'So: {"summary": {"x": 2}} end }'):
        assert '"summary"' in grouped.first_json(raw)
    assert grouped.first_json("none") is None
    text = "Use 42 of [1, 2]."
    masked, found = grouped.mask_tokens(text, r"\[[\d, ]+\]|\d+", 0)
    assert grouped.restore_tokens(masked, found) == text and grouped.restore_tokens("ok.", found) == "ok 42 [1, 2]."


def test_states():
    assert grouped.fold_job(["START", "PARSED", "PAUSE"])[-1] == ("paused", 40, 0)
    assert grouped.fold_job(["START", "PARSED", "RETRY"])[-1] == ("queued", 0, 1)
    folded = grouped.fold_task([("START_PARSE", 0), ("LAYOUT_DONE", 0), ("PARSE_DONE", 0), ("START_TRANSLATION", 2), ("BLOCKS_VALIDATED", 3), ("BLOCKS_VALIDATED", 2), ("TRANSLATION_DONE", 0)])
    assert [x[4] for x in folded] == [True, False, True, True, False, True, True] and folded[-1][0] == "composing"
    assert grouped.throttle([("a", 0), ("a", 1), ("b", 1.5), ("b", 3.6)]) == [True, False, True, True]


def test_boxes():
    assert grouped.merge_boxes([(0, 0, 50, 50), (52, 0, 50, 50), (500, 0, 10, 10)]) == [(0, 0, 102, 50)]
    assert grouped.dedup_boxes([((0, 0, 10, 10), False), ((1, 1, 8, 8), True)]) == [1]
    assert grouped.text_rows([(20, 0, 10, "b"), (0, 1, 10, "a"), (0, 30, 10, "c")]) == ["a b", "c"]


def test_per_group_streams(spark):
    df = spark.range(1000).selectExpr("id % 37 AS k", "id AS v")
    got = {r.k: (r.n, r.first) for r in grouped.per_group(df, ["k"], ["v"], lambda pdf: [(len(pdf), int(pdf.v.iloc[0]))], "n long, first long").collect()}
    assert got == {k: (len(range(k, 1000, 37)), k) for k in range(37)}


def test_stream_matches_batch(spark, tmp_path):
    from lectern.streaming import events as S

    rows = spark.range(200).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id * 60) AS ts", "id % 5 AS user_id", "'click' AS event_type", "double(id) AS value", "'{}' AS props", "element_at(array('START', 'PARSED', 'PAUSE'), int(id % 3) + 1) AS name")
    rows.drop("name").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = S.tumbling(S.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, S.tumbling(spark.read.parquet(str(tmp_path / "in"))).collect()))
    assert S.job_states(rows.select("user_id", "ts", "event_id", "name")).count() == 5
    assert S.once(rows).count() == 200 and S.sessions(rows).count() == 5
