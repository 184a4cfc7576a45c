import random

import pytest

import corpus_pipeline as P
from lectern.llm import near_copies


def shingles(text, words=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute_force(rows, least=0.8):
    root, sets = {i: i for i, _ in rows}, [(i, shingles(t)) for i, t in rows]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x == y or len(x & y) / len(x | y) >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def fixture():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for n, changes in ((100, 1), (100, 2), (60, 1), (300, 3), (300, 6), (30, 1), (4, 0), (4, 1)):
        for _ in range(8):
            text = [rng.choice(words) for _ in range(n)]
            copy = list(text)
            for at in rng.sample(range(n), changes):
                copy[at] = rng.choice(words)
            rows += [" ".join(text), " ".join(copy)]
    base = [rng.choice(words) for _ in range(120)]  # a large group: each a word or six from one text
    for k in range(40):
        copy = list(base)
        for at in rng.sample(range(120), 1 if k % 3 else 6):
            copy[at] = rng.choice(words)
        rows.append(" ".join(copy))
    passage = [rng.choice(words) for _ in range(40)]  # and one passage in documents that are otherwise unlike
    rows += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(5, 60))]) for _ in range(30)]
    rows += ["", " \n", None, "ONE two", "one  TWO"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("group", [48, 5])
def test_against_brute_force(spark, group):
    rows = fixture()
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), group=group).collect()}
    assert got == brute_force(rows)


def test_pipeline_stage_drops_near_copies_in_pairs(spark):
    rows = [(i, t, "aa", "s", 1) for i, t in fixture() if t]
    kept = dict(P.STAGES)["simhash"](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    want = brute_force([(r[0], r[1]) for r in rows])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
