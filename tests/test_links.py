"""Links without properties against the merged edges, dealt to few and to many tasks."""

import pytest

from weftgraph.plans import views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("pairs", [500_000, 100])
def test_links_are_the_merged_edges(spark, monkeypatch, pairs):
    monkeypatch.setattr(views, "PAIRS", pairs)
    links = views.kg_links(spark, SF)
    assert sorted(links.collect()) == sorted(views.kg_edges(spark, SF).select("src", "edge_type", "dst").collect())
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionByExpression") == (2 if pairs == 100 else 0)
