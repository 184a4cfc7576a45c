import re

from lectern.plans import QUERIES

TITLES = ["one two three four", "one two five six", "one seven eight nine", "ten eleven twelve thirteen", "one two three five"]


def test_pairs_over_a_fifth(spark, tmp_path):
    rows = [(i, t + "\nbody", f"l{i}", "s", 1) for i, t in enumerate(TITLES)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    sets = {i: set(re.findall("[a-z0-9]+", f"{text.split(chr(10))[0]} {lang} {source}")) for i, text, lang, source, _ in rows}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b}
    want = {k: v for k, v in want.items() if v > 0.2}
    assert min(want.values()) < 0.5
    assert {(r.a, r.b): r.score for r in QUERIES["j04_title_tag_jaccard"](spark, str(tmp_path)).collect()} == want
