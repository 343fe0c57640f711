"""A dimension too big to broadcast and a fact whose hottest key (the missing device
id of everyone who never checked out) holds a third of the rows: the sort-merge
fallback must split that key's partition (AQE skew join), and keep every row."""

from pyspark.sql import functions as F

from rollcall.operators import role_join

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def test_hot_null_key_is_split_not_dropped(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        n = 150_000
        fact = spark.range(n).select(
            F.col("id").alias("r"),
            F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise((F.col("id") % 997).cast("string"))
             .alias("in_device_id"))
        dim = spark.range(1000).select(F.col("id").cast("string").alias("device_id"),
                                       F.concat(F.lit("Gate "), F.col("id")).alias("loc"))
        out = role_join(fact, dim, {"in_device_id": "in_location"}, "device_id", "loc", broadcast=False)
        stats = out.agg(F.count(F.lit(1)).alias("n"), F.count("in_location").alias("located")).first()
        assert stats["n"] == n                         # every fact row kept
        assert stats["located"] == n - (n + 2) // 3    # all but the null-id rows found a gate
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "skew=true" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_salted_join_equals_plain_join_and_splits_hot_keys(spark):
    from rollcall.operators import hot_keys, left_join_null_safe
    n = 30_000
    fact = spark.range(n).select(
        F.col("id").alias("r"),
        F.when(F.col("id") % 3 == 0, F.lit(None))
         .when(F.col("id") % 3 == 1, F.lit("7"))
         .otherwise((F.col("id") % 500).cast("string")).alias("k"))
    dim = spark.range(500).select(F.col("id").cast("string").alias("dk"),
                                  F.concat(F.lit("Gate "), F.col("id")).alias("loc"))
    dim = dim.unionByName(spark.range(1).select(F.lit("7").alias("dk"), F.lit("Gate 7 again").alias("loc")))
    assert {r[0] for r in hot_keys(fact, "k", 0.1).collect()} == {None, "7"}
    salted = left_join_null_safe(fact, dim, "k", "dk", broadcast=False, salt_buckets=8, hot_share=0.1)
    plain = left_join_null_safe(fact, dim, "k", "dk", broadcast=True)
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        a = sorted((tuple(r) for r in salted.select("r", "k", "loc").collect()), key=repr)
        smj = [line for line in salted._jdf.queryExecution().executedPlan().toString().splitlines()
               if "SortMergeJoin" in line]
        assert smj and "__salt" in smj[0]              # the join also matches on the salt
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    b = sorted((tuple(r) for r in plain.select("r", "k", "loc").collect()), key=repr)
    assert a == b
    assert len(a) > n                               # key "7" is listed twice: its rows double
    assert salted.columns == plain.columns
