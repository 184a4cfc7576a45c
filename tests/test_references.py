from pyspark.sql import functions as F

from lectern.functions import rules as R
from lectern.operators import search, sections
from lectern.operators.references import match_references

REFS, PAPERS = "ref int, owner int, title string, doi string", "paper int, title string, doi string, ord int"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def matched(spark, refs, papers):
    got = match_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(papers, PAPERS))
    return {r.ref: (r.paper, r.confidence) for r in got.collect()}


def test_references_by_doi_title_and_similar_title(spark):
    long = "Scalable Accelerator Architecture for Zero Knowledge Proofs"
    papers = [(1, "A", None, 1), (2, "B", "10.1/x", 2), (3, "B!", "https://doi.org/10.1/X", 3), (4, "SZKP: A " + long, "", 4), (5, "szkp: a " + long.lower(), None, 5)]
    refs = [
        (1, 1, "other", "10.1/X"), (2, 1, "b", None), (3, 1, long, None), (4, 5, long, None), (5, 1, "nothing like it", ""), (6, 1, None, None),
        (7, 3, "B", "10.1/x"), (8, 1, "b", "10.9/unknown"), (9, None, "A", None),
    ]
    assert matched(spark, refs, papers) == {
        1: (3, 1.0), 2: (2, 0.82), 3: (5, 0.82), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None), 8: (2, 1.0), 9: (1, 0.82),
    }
    assert matched(spark, [], papers) == {} and matched(spark, refs[:1], []) == {1: (None, None)}


def test_similar_titles_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    words = [f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(4000)]
    titles = [" ".join(words[k : k + rng.randrange(1, 9)]) for k in range(0, 1200, 10)]
    papers = [(k, x, None, k) for k, x in enumerate(titles[:60])]
    refs = [(k, -1, x, None) for k, x in enumerate(titles[60:])]

    def best(title):
        for k, x, *_ in papers:
            if x == title:
                return k
        found, score, a = None, 0.72, set(title.split())
        for k, x, *_ in papers:
            b = set(x.split())
            s = 0.6 * (len(a & b) / min(len(a), len(b))) + 0.4 * (len(a & b) / len(a | b))
            found, score = (k, s) if s >= score else (found, score)
        return found

    want = {k: best(x) for k, _, x, _ in refs}
    assert {k: p for k, (p, _) in matched(spark, refs, papers).items()} == want and sum(x is not None for x in want.values()) > 5


def test_publisher_lines_go(spark):
    text = ["Title", "Corresponding author: x, doi.org/", "Permission to make digital copies", "of this", None, " see DOI.org/1 ", "Body", "2024 Copyright", "ACM ISBN 1", " DAC '24, June", "∗ This paper was accepted", "End "]
    rows = [(1, k, x) for k, x in enumerate(text)] + [(2, 0, "Permission to make hard copies"), (2, 1, "never ends"), (3, 0, "a doi.org/ line stays")]
    got = sections.without_publisher_lines(spark.createDataFrame(rows, "doc int, pos int, line string"), "doc", "pos", "line")
    assert dict(got.collect()) == {1: "Title\nBody\nEnd", 2: "", 3: "a doi.org/ line stays"}


def test_spans_are_found_on_both_sides(spark):
    spans = [("Beta  test", "b"), ("alpha", "A"), ("ALPHA", "a"), ("alpha", "zz"), ("", "a"), (None, "a"), ("alpha", "b")]
    cell = F.array(*[F.struct(F.lit(a).cast("string").alias("left"), F.lit(b).alias("right")) for a, b in spans])
    got = one(spark, R.valid_spans(F.lit("Alpha beta\ntest"), F.lit("a b"), cell))
    assert [tuple(x) for x in got] == [("alpha", "A"), ("alpha", "b"), ("Beta  test", "b")]
    assert one(spark, R.valid_spans(F.lit(None).cast("string"), F.lit("a"), cell)) == []


def test_entries_go_on(spark):
    cases = {("inter-", "national"): "international", ("10-", "20"): "10-20", ("X-", "Ray"): "X- Ray", ("http://a.b/", "c"): "http://a.b/c", ("see https:", "//x"): "see https://x", ("http://a", "b"): "http://a b", ("a", "b"): "a b"}
    assert {k: one(spark, R.continue_entry(F.lit(k[0]), F.lit(k[1]))) for k in cases} == cases


def test_queries_expand(spark):
    assert one(spark, R.expanded_query(F.lit("TSV x"))) == "TSV x tsv through-silicon-via thermal 3d-integration x"
    assert one(spark, R.expanded_query(F.lit("x"), F.array(F.lit("y"), F.lit("x")))) == "x y"
    assert one(spark, R.expanded_query(F.lit(None).cast("string"), F.lit(None).cast("array<string>"))) == ""


def test_candidates_fall_back_to_the_first(spark):
    docs = spark.createDataFrame([(k, 10 - k) for k in range(5)], "doc_id int, ord int")
    found = spark.createDataFrame([(1, 2.0), (3, 2.0), (0, 5.0), (4, 1.0)], "doc_id int, score double")
    assert [tuple(r) for r in search.candidates(found, docs, 3).orderBy(F.desc("score"), "doc_id").collect()] == [(0, 5.0), (1, 2.0), (3, 2.0)]
    assert [tuple(r) for r in search.candidates(found.limit(0), docs, 4).orderBy(F.desc("score")).collect()] == [(4, 1.0), (3, 0.75), (2, 0.5), (1, 0.25)]
    assert search.candidates(found.limit(0), docs.limit(0)).count() == 0


def test_evidence_takes_the_best_pages_of_the_best(spark):
    rows = [(k, f"t{k}", ["none", f"alpha beta {k}", "alpha", "beta and alpha"]) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id int, title string, pages array<string>")
    found = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 3.0), (3, 0.5)], "doc_id int, score double")
    got = search.evidence(found, docs, ["alpha", "beta"], results=3, each=2, most=5).orderBy("place").collect()
    assert [(r.place, r.doc_id, r.title, r.page, r.hits) for r in got] == [(1, 1, "t1", 2, 2), (2, 1, "t1", 4, 2), (3, 2, "t2", 2, 2), (4, 2, "t2", 4, 2), (5, 0, "t0", 2, 2)]
    assert got[0].snippet == "alpha beta 1" and search.evidence(found.limit(0), docs, ["alpha"]).count() == 0


def test_anchors_are_labelled_blocks(spark):
    rows = [(1, "a", "section", "1.2 Methods ", None, 0), (1, "b", "figure", "", "Fig. 3 x", 1), (1, "c", "table", None, "Table 2", 2), (1, "d", "section", "Plain words", None, 3), (1, "e", None, None, None, 4), (1, "f", "paragraph", "图 4", "Table 9", 5)]
    got = sections.anchors(spark.createDataFrame(rows, "doc int, block string, kind string, text string, caption string, ord int"))
    assert sorted((r.block, r.label, r.kind, r.text) for r in got.collect()) == [("a", "sec1.2", "section", "1.2 Methods"), ("b", "fig3", "caption", "Fig. 3 x"), ("c", "tab2", "caption", "Table 2"), ("f", "fig4", "caption", "图 4")]


def test_headings_are_parsed(spark):
    cases = {
        "2 Background 2.1 Motivation": [("2", 1, "Background"), ("2.1", 2, "Motivation")], "V. Related Work": [("V", 1, "Related Work")], "C. Setup": [("C", 2, "Setup")], "1.2.3\t Deep\r": [("1.2.3", 3, "Deep")],
        "IX Results\nA. One": [("IX", 1, "Results"), ("A", 2, "One")], "No number 2 Later": [(None, 1, "No number 2 Later")], "3 4": [(None, 1, "3 4")], " ": [], "C Setup": [(None, 1, "C Setup")],
    }
    assert {x: [tuple(p) for p in one(spark, R.heading_parts(F.lit(x)))] for x in cases} == cases
    assert one(spark, R.heading_parts(F.lit(None).cast("string"))) == []


def test_headings_get_their_number_back(spark):
    cases = {("2.1 A", "x 2.1  y"): "2.1 x y", ("2.1 A", "2.1 x"): "2.1 x", ("2 A", "2：x"): "2：x", ("2 A", "x"): "x", ("A", "x 2"): "x 2", ("2 A", "12 2.1 x 2 and 2"): "2 12 2.1 x and 2", ("1.2 A", "1x2 b"): "1x2 b"}
    assert {k: one(spark, R.restored_heading(F.lit(k[0]), F.lit(k[1]))) for k in cases} == cases
    assert one(spark, R.restored_heading(F.lit("1 A"), F.lit(None).cast("string"))) is None
