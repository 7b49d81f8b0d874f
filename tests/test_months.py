from pyspark.sql import functions as F

from curbflow.plans import registry
from curbflow.plans.pipeline import Chain

SMALL = "/root/testdata/sf0.001"


def test_months_are_cut_from_one_stored_read(spark, tmp_path):
    """Every month file joined the trips anew."""
    chain = Chain.over_tables(spark, SMALL)
    registry._write_months(chain, str(tmp_path / "raw"))
    staged = chain.__dict__["staged_yellow"]
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert sorted(staged.drop("_place").collect(), key=str) == sorted(
        chain.raw_taxi.collect(), key=str
    )
    for k, row in enumerate(staged.groupBy("_place").count().orderBy("_place").collect()):
        month = spark.read.parquet(
            f"{tmp_path}/raw/yellow/yellow_tripdata_2024-{k + 1:02d}.parquet"
        )
        assert month.count() == row["count"]
        assert month.where(F.month("tpep_pickup_datetime") % 3 != k).isEmpty()


def test_lines_are_joined_to_orders_that_know_their_customer(spark):
    chain = Chain.over_tables(spark, SMALL)
    plan = chain.raw_taxi._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert ["l_suppkey" in joins[0], "l_orderkey" in joins[1], "o_custkey" in joins[2]] == [True] * 3
