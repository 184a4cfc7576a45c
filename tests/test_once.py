"""What is looked at once only."""

import random

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import grouped as G
from lectern.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_made_plain_once_for_all_spans(spark):
    assert "contains(trim(" not in plan(spark, "t60_valid_spans")


def test_sentences_are_cut_once(spark):
    assert plan(spark, "t12_sentence_candidates").count("regexp_extract_all") == 1


def test_patterns_that_begin_with_the_dot(spark):
    cases = {"See Fig.Fig. 1, figs. et al. x.": ["See Fig.Fig. 1, figs. et al. x."], "I.E. so": ["I.E. so"], "e.g.g. i": ["e.g.g.", "i"], "no.. x?": ["no.", ".", "x?"], "1.2.3": ["1.2.", "3"], "Pig. y": ["Pig.", "y"]}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.sentences(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == cases


def whole_search(words, needle, start):
    n = len(needle)
    row, best = [(i, start) for i in range(n + 1)], (n, start, start)
    for at in range(start, len(words)):
        diagonal, row[0] = row[0], (0, at + 1)
        for i in range(1, n + 1):
            cost = diagonal[0] + (needle[i - 1] != words[at])
            found = min((cost, diagonal[1]), (row[i][0] + 1, row[i][1]), (row[i - 1][0] + 1, row[i - 1][1]), key=lambda x: x[0])
            diagonal, row[i] = row[i], found
        if row[n][0] < best[0]:
            best = row[n][0], row[n][1], at + 1
    return (best[1], best[2], min(0.95, 1 - best[0] / n)) if 1 - best[0] / n >= 0.82 else None


def test_approximate_range_against_the_whole_search():
    rng = random.Random(4)
    hits = 0
    for _ in range(1500):
        kinds, n = rng.choice([2, 4, 12]), rng.randint(4, 25)
        words = [str(rng.randrange(kinds)) for _ in range(rng.randint(n, 60))]
        at = rng.randrange(len(words) - n + 1)
        needle = words[at : at + n]
        for _ in range(rng.randint(0, 4)):
            needle[rng.randrange(n)] = "x"
        start = rng.choice([0, 3])
        want = None if 2 * (len(words) - start) < n else whole_search(words, needle, start)
        assert G.approximate_range(words, needle, start) == want
        hits += want is not None
    assert hits > 500


def test_words_far_from_a_piece_are_not_compared_one_by_one():
    class Word(str):
        compared = 0

        def __ne__(self, other):
            Word.compared += 1
            return not str.__eq__(self, other)

        __hash__ = str.__hash__

    words = [Word(f"w{k}") for k in range(5000)]
    needle = [Word(f"w{k}") for k in range(4000, 4011)]
    assert G.approximate_range(words, needle) == (4000, 4011, 0.95)
    assert Word.compared < 11 * 30
