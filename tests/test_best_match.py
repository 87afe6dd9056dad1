from pyspark.sql import functions as F

from folioframe.operators import relational as rel


def test_best_match_meets_one_row_a_join_value(spark):
    left = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None), (5, 9)], "l int, v int")
    right = spark.createDataFrame([(1, 0, 5), (2, 0, 7), (3, 0, 7), (4, 1, 1), (5, None, 9)], "r int, w int, s int")
    got = rel.best_match(left, right, F.col("v"), F.col("w"), "l", F.col("s"), ["r"], ["r"])
    assert sorted(map(tuple, got.collect())) == [(1, 2, 7), (2, 2, 7), (3, 4, 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join") :]
    assert "Aggregate" in join  # the right side is reduced below the join
