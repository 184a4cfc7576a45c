import re

import corpus_pipeline as P
from lectern.llm import components, line_dedup, mixing, near_copies, packing
from lectern.session import durable


def workers_a_task(plan: str) -> int:
    """Most Python operators in one task: those on a way through the plan that no exchange cuts."""
    most, above = 0, []  # (depth, operators so far) of the nodes above
    for line in plan.splitlines():
        found = re.match(r"[ :+\-*()\d]*", line)
        if not line.strip() or line.startswith("=="):
            continue
        depth, name = len(re.match(r"[ :+\-]*", line).group()), line[found.end() :]
        above = [a for a in above if a[0] < depth]
        so_far = 0 if "Exchange" in name.split()[0] else above[-1][1] if above else 0
        so_far += bool(re.match(r"\w*(InArrow|InPandas|EvalPython|ArrowPython)", name))
        above.append((depth, so_far))
        most = max(most, so_far)
    return most


def test_a_task_of_the_pipeline_has_one_python_worker(spark, monkeypatch):
    seen = []

    def watched(df, name="table", **options):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen.append((name, workers_a_task(plan), bool(re.search(r"ExistingRDD|ExternalRDD", plan))))
        return durable(df, name, **options)

    for module in (components, line_dedup, mixing, near_copies, packing):
        monkeypatch.setattr(module, "durable", watched)
    twice = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(i, f"{twice} number {i}" if i % 3 else f"{i} this is another text of its own {i * i}\nwith a line", "en", f"src{i % 4}", 9) for i in range(40)]
    docs = durable(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    twofold = docs.mapInArrow(lambda it: it, docs.schema).mapInArrow(lambda it: it, docs.schema)
    assert workers_a_task(twofold._jdf.queryExecution().executedPlan().toString()) == 2
    assert workers_a_task(twofold.repartition("doc_id").mapInArrow(lambda it: it, docs.schema)._jdf.queryExecution().executedPlan().toString()) == 2
    for name, stage in P.STAGES:
        docs = watched(stage(spark, docs, ""), name)
    assert {"near-sets", "mix-bounds", "pack-ids"} <= {x[0] for x in seen}
    assert [x for x in seen if x[1] > 1] == []
    # rows that a Python worker unpickles, in a pool of its own
    assert [x[0] for x in seen if x[2]] == []
