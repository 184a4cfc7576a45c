from lectern.llm import lang_id


def test_a_rare_label_among_many_stays(spark):
    rows = [(k * 200 + i, f"label {k} text {i}", f"l{k}") for k in range(30) for i in range(200)] + [(9000 + i, "rare words", f"rare{i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert lang_id.fit(docs, max_rows=60, landmarks=40).labels == sorted({r[2] for r in rows})
