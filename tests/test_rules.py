from pyspark.sql import functions as F

from lectern.functions import rules as R
from lectern.operators import sections

LINES = "doc long, page long, pos long, line string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sample_pages(spark):
    got = {n: one(spark, R.sample_pages(F.lit(n))) for n in (1, 2, 3, 5, 7, 9)}
    assert got == {1: [1], 2: [1, 2], 3: [1, 2, 3], 5: [1, 2, 3, 5], 7: [1, 2, 4, 6], 9: [1, 3, 5, 7]}
    assert one(spark, R.sample_pages(F.lit(None).cast("int"))) is None


def test_issue_keys_round_halves_up(spark):
    key = R.issue_key(F.lit(2), F.lit("overlap"), [F.lit(x) for x in (4.9, 5.0, -5.0, 15.0)], F.lit("  Two Lines "))
    assert one(spark, key) == "2|overlap|0|10|0|20|two lines"


def test_label_identity_and_links(spark):
    labels = {"Fig. 3": "figure:3", "see FIGURE 2.1": "figure:2.1", "Table IV": "table:iv", "Code 7-2": "code:7-2", "Figures": None, "": None}
    assert {x: one(spark, R.label_identity(F.lit(x))) for x in labels} == labels
    assert one(spark, R.label_identity(F.lit(None).cast("string"))) is None

    def link(*x):
        return one(spark, R.contradictory_link(*(F.lit(v).cast("string") for v in x)))

    assert link("none", "ends", None, None) and link("continues", "starts", None, None) and link("continues", "ends", "Fig. 1", "Fig. 2")
    assert not link("continues", "ends", "Fig. 1", "Figure 1") and not link(None, None, "Fig. 1", None)


def test_split_errors(spark):
    assert one(spark, R.splits_batch(F.lit("DeepSeekProtocolError"))) and not one(spark, R.splits_batch(F.lit("TypeError"))) and not one(spark, R.splits_batch(F.lit(None).cast("string")))


def test_mapping_names_every_sentence_once_and_in_order(spark):
    cases = [
        ([(["a", "b"], ["x"]), (["c"], ["y", "z"])], True), ([(["b", "a"], ["x"]), (["c"], ["y"])], False), ([(["a", "b", "c"], [])], False),
        ([(["a", "b", "c"], ["x", " "])], False), ([([], ["x"]), (["a", "b", "c"], ["y"])], False), ([(["a", "b"], ["x"])], False), ([], False),
    ]
    rows = [(i, [{"src": s, "dst": d} for s, d in groups]) for i, (groups, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, g array<struct<src:array<string>,dst:array<string>>>")
    got = dict(df.select("i", R.exact_mapping(F.array(*map(F.lit, "abc")), F.col("g"))).collect())
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_bibliography_opens_closes_and_goes_on(spark):
    text = {1: ["Intro", "7 References [1] One.", "[2] Two."], 2: ["[3] Three.", "Appendix A", "Four"], 3: ["Five", "参考文献", None, "[4] Six"], 4: ["References are many"]}
    rows = [(1, page, k, x) for page, xs in text.items() for k, x in enumerate(xs)] + [(2, 1, 0, "[1] no heading"), (3, 1, 0, "Bibliography"), (3, 1, 1, "  ")]
    got = sections.bibliography(spark.createDataFrame(rows, LINES), "doc", "page", "pos", "line").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "[1] One.\n[2] Two."), (1, 2, "[3] Three."), (1, 3, "\n[4] Six"), (1, 4, "References are many")]
    assert sections.bibliography(spark.createDataFrame([], LINES), "doc", "page", "pos", "line").count() == 0


def test_chapters_follow_heads_and_are_cut(spark):
    rows = [(1, 1, k, x) for k, x in enumerate(["before", "#A", "one", None, "two", "#B", " ", "#C", "x" * 9])]
    df = spark.createDataFrame(rows, LINES)
    got = sections.chapters(df, "doc", "pos", "line", F.col("line").startswith("#"), most=7).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "one\n\ntw"), (1, 3, "xxxxxxx")]
