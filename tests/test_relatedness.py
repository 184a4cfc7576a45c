import math
import random
import re
from collections import Counter

import pytest

from lectern.plans import QUERIES


def fixture():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    return [(i, "common " + rng.choice(words) + "\n" + " ".join(rng.choice(words) for _ in range(rng.randint(1, 25))), "en", "s", 1) for i in range(45)]


def brute_force(rows):
    """All pairs by the reference's rule: title words weigh 5, those of the first 2000 characters 1."""
    tokens = lambda s: [x for x in re.sub("[^a-z0-9]+", " ", s.lower()).split(" ") if len(x) > 1]
    vectors = {}
    for i, text, *_ in rows:
        v = vectors[i] = Counter()
        for x in tokens(text.split("\n")[0]):
            v[x] += 5
        for x in tokens(text[:2000]):
            v[x] += 1
    norm = {i: sum(x * x for x in v.values()) for i, v in vectors.items()}
    pairs = {(a, b): sum(w * vectors[b][x] for x, w in vectors[a].items()) / math.sqrt(norm[a] * norm[b]) for a in vectors for b in vectors if a < b}
    return {k: w for k, w in pairs.items() if w >= 0.08}


def nearest(pairs):
    out = set()
    for node in {x for k in pairs for x in k}:
        ends = sorted((-round(w, 9), b if a == node else a, (a, b)) for (a, b), w in pairs.items() if node in (a, b))
        out |= {k for _, _, k in ends[:3]}
    return out


def test_terms_of_many_documents_count(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_force(rows)
    assert len(want) > 900  # nearly all: each has the word "common" in its title
    got = {(r.a, r.b): r.weight for r in QUERIES["j05_cosine_pairs"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-6)
    for name in ("w02_top3_neighbours", "k17_relatedness"):
        assert {(r.a, r.b) for r in QUERIES[name](spark, str(tmp_path)).collect()} == nearest(want), name
