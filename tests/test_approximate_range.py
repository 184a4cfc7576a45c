from lectern.plans import QUERIES


def test_later_words_are_searched(spark, tmp_path):
    words = [f"w{k}" for k in range(450)]
    words[430:441] = [*words[9:14], "changed", *words[15:20]]
    spark.createDataFrame([(1, " ".join(words), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["k25_approximate_range"](spark, str(tmp_path)).collect()
    assert [(r["first"], r.end, r.confidence) for r in got] == [(430, 441, 0.95)]
