import random

from lectern.operators import grouped as G


def test_groups_over_batches_and_missing_keys(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(None if k == 5 else k, str(k % 2) if k % 3 else None, v, float(v) if v else None) for k in range(30) for v in range(1 + k % 4 * 9)]
        random.Random(1).shuffle(rows)
        df = spark.createDataFrame(rows, "k long, part string, v long, x double")
        got = G.per_lists(df, ["k", "part"], ["v"], ["v", "x"], lambda v, x: [(len(v), v, sum(a != a for a in x))] if len(v) != 10 else [], "n long, vs array<long>, missing long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = {}
    for k, part, v, _ in rows:
        want.setdefault((k, part), []).append(v)
    assert {(r.k, r.part): (r.n, r.vs, r.missing) for r in got} == {k: (len(v), sorted(v), v.count(0)) for k, v in want.items() if len(v) != 10}
    assert len(got) == len({(r.k, r.part) for r in got})


def test_boxes_reach_python_as_lists_and_only_what_is_needed(spark, monkeypatch):
    """What a row costs: no data frame is cut into groups."""
    from lectern.plans import QUERIES

    monkeypatch.setattr(G, "per_group", None)
    for name in ("g03_merge_boxes", "g11_dedup_regions", "w12_text_rows", "w14_bibliography_rows"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_shipdate" not in plan.split("Relation")[0] and "MapInArrow" in plan


def test_regions_against_each_pair():
    rng = random.Random(2)
    for _ in range(300):
        boxes = [((rng.randint(0, 9), rng.randint(0, 9), rng.randint(0, 9), rng.randint(0, 9)), rng.random() < 0.5) for _ in range(rng.randint(0, 9))]
        kept = []
        for i, (box, captioned) in enumerate(boxes):
            clash = next((k for k, j in enumerate(kept) if G.area(box, boxes[j][0]) >= 0.8 * max(G.TINY, min(box[2] * box[3], boxes[j][0][2] * boxes[j][0][3]))), None)
            if clash is None:
                kept.append(i)
            elif (captioned, box[2] * box[3]) > (boxes[kept[clash]][1], boxes[kept[clash]][0][2] * boxes[kept[clash]][0][3]):
                kept[clash] = i
        assert G.dedup_boxes(boxes) == kept
