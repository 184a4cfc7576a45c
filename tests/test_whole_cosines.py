from lectern.plans import QUERIES


def test_terms_past_the_first_2000_characters_count(spark, tmp_path):
    rows = [(i, f"t{i}\n" + "".join(f"a{i}x{k} " for k in range(500)) + "same " * 300) for i in range(2)]
    assert all(t.index("same") > 2000 for _, t in rows)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.a, r.b) for r in QUERIES["j05_cosine_pairs"](spark, str(tmp_path)).collect()] == [(0, 1)]
