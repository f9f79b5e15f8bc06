"""The steps of op9 read stored rows, so that the plan of each step is small."""

from __future__ import annotations

from profitlens.llm import quality_rules as Q


def test_steps_read_stored_rows(spark, monkeypatch):
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, "en", f"s{i % 2}", words) for i in range(40)], "doc_id long, lang string, source string, text string")
    plans, estimate = [], Q.group_estimates
    monkeypatch.setattr(Q, "group_estimates", lambda rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or estimate(rows))
    assert {r.kept for r in Q.apply_rules(docs).collect()} == {True}
    assert "Join" not in plans[0] and "Generate" not in plans[0]
