from lectern.plans import QUERIES


def test_candidates_past_the_first_fifty_are_weighed(spark, tmp_path):
    rows = [(i, "attion same\nword", "en", "s", 1) for i in range(60)] + [(60, "attion other\nword more", "fr", "q", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["l03_mmr_v1"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 60, *range(1, 14)]
