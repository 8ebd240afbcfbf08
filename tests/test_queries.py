"""Every query of the page operators against SQL, or that it runs where SQL can't express it."""

import pytest
from compare import same_rows

from leafmark.plans import PLANS

QUERIES = {name: query for plan in PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small, name):
    if name in ORACLES:
        same_rows(spark, small, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, small).count() > 0


def test_every_line_is_a_claim(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect()
    plans = {}
    for part, supplier in lines:
        plans.setdefault(part, set()).add(supplier)
    want = {(part, len(own), min(own)) for part, own in plans.items() if len(own) > 1}
    assert {tuple(r) for r in QUERIES["claim_conflicts_all"](spark, small).collect()} == want


def test_every_language_is_compared(spark, tmp_path):
    docs = [(1, "ab", "en"), (2, "bc", "fr"), (3, "bß", "de"), (4, "bñ", None), (5, None, "es")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    own = {lang: set(text or "") for _, text, lang in docs}
    want = {(ch, x, y) for x in own for y in own if x != y for ch in own[x] - own[y]}
    assert {tuple(r) for r in QUERIES["coverage_candidates_all"](spark, str(tmp_path)).collect()} == want


def test_no_two_plans_share_a_name():
    assert len(QUERIES) == sum(len(plan.QUERIES) for plan in PLANS) and set(ORACLES) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
