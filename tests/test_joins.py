import pytest
from pyspark.sql import functions as F

from readloom.operators.joins import apart

LOW = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_frequent_key_is_dealt_out(spark, tmp_path, kind):
    spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast(kind).alias("k"), F.col("id").alias("v")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    least = rows.groupBy("k").agg(F.min("v").alias("m"))
    before = {k: spark.conf.get(k, None) for k in LOW}
    try:
        for k, v in LOW.items():
            spark.conf.set(k, v)
        plans = {}
        for name, side in (("in place", least), ("apart", apart(least, "k"))):
            run = rows.join(side, "k", "left")._jdf.queryExecution()
            plans[name] = run.toRdd().count(), "skew=true" in run.executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert plans == {"in place": (200_000, False), "apart": (200_000, True)}
    assert rows.join(apart(least, "k"), "k").agg(F.count("m")).first()[0] == 200_000
