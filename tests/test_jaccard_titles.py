import __spark_entry__


def test_title_pairs_over_the_bound_of_the_sql(spark, tmp_path):
    """Titles with a Jaccard of over 0.2 are pairs, those of 0.2 itself aren't."""
    titles = ["aa bb cc\nbody", "AA xx yy\nbody", "aa bb dd ee\nzz", "xx yy zz vv ww uu tt ss rr qq", "aa bb cc", "", None, "a b", "kk ll", "kk mm"]
    spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b): r.score for r in __spark_entry__.queries()["u01_jaccard_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(0, 2): 0.4, (0, 4): 1.0, (2, 4): 0.4, (8, 9): 0.333333}
