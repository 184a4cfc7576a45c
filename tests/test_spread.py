import pytest

from lectern import session
from lectern.operators import graph
from lectern.plans import QUERIES

SF = "/root/testdata/sf0.01"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["w22_thin_row_clusters", "j28_paragraph_flow", "j24_integrity", "a04_weighted_terms", "a05_norms"])
def test_tasks_grow_in_number_with_the_tables(spark, monkeypatch, name):
    """Tables are dealt to as many tasks as their stored size asks for, and windows and groups keep that."""
    size = session.pieces.__defaults__
    try:
        session.pieces.__defaults__ = (1,)
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert session.pieces(spark.read.parquet(f"{SF}/documents.parquet")) == 2
        deals = plan(spark, name).count("REPARTITION_BY_NUM")
    finally:
        session.pieces.__defaults__ = size
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert deals


def test_texts_of_an_integrity_check_are_digests(spark):
    assert "keys=[text" in plan(spark, "j24_integrity") and "sha2(" in plan(spark, "j24_integrity")


def test_rounds_of_ranking_go_over_pairs(spark, monkeypatch):
    """An edge that is there a thousand times is one row of each round."""
    counted = {}
    real = graph.durable

    def durable(df, name="table", **options):
        out = real(df, name, **options)
        counted[name] = out.count()
        return out

    monkeypatch.setattr(graph, "durable", durable)
    edges = spark.range(3000).selectExpr("id % 3 AS source", "(id + 1) % 3 AS target", "1.0D AS w")
    got = {r.id: r["rank"] for r in graph.page_rank(spark.range(3).selectExpr("id", "0.0D AS p"), edges, iterations=5).collect()}
    assert counted["rank-shares"] == 3 and got == pytest.approx(dict.fromkeys(range(3), 1 / 3))
