"""The second evaluation of A10 is dealt by size and not into a fixed number of tasks."""

from tidemark.plans.queries_changes import unstable_documents


def test_second_evaluation_has_no_fixed_number_of_tasks(spark):
    # without adaptive execution Spark takes no rebalance hint
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        plan = unstable_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
    assert "RebalancePartitions" in plan and "RepartitionByExpression" not in plan
