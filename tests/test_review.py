"""Queries of the review that read and join their tables once."""

import re

from caseweave.plans import review

SF = "/root/testdata/sf0.001"


def test_the_ledger_reads_its_actions_once(spark):
    df = review.applied_ledger(spark, SF)
    assert len(re.findall(r"Relation ?\[l_orderkey", df._jdf.queryExecution().optimizedPlan().toString())) == 1
    done = review._applied(spark, SF)
    parts = done.events.selectExpr("case_id", "seq", "field", "after").union(done.refused.selectExpr("case_id", "seq", "action", "NULL"))
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, map(tuple, parts.collect())))


def test_facts_read_orders_once(spark):
    df = review._facts(spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation ?\[o_orderkey", plan)) == 1 and plan.count("Join ") == 1
    price = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice").collect()}
    rows = df.select("claim_id", "fact_id", "proof_state").collect()
    assert len(rows) == sum(1 + k % 2 for k in price) and "_price" not in df.columns
    assert all(r["proof_state"] == ("insufficiente" if price[r["claim_id"]] < 150000 else "provato") for r in rows if r["fact_id"] % 2)
