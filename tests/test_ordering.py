from __future__ import annotations

import pytest
from conftest import rows, same
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetpulse.operators import anomaly, health, ordering, prepare, reasoning, residuals


def test_bucketed_numbers_equal_plain_row_numbers(spark, trajectories):
    shuffled = trajectories.drop("seq").withColumn("t", F.col("cycle") * 1000 + F.abs(F.xxhash64("Xs_T48")) % 1000)
    order = ["t", "Xs_T48"]
    plain = shuffled.withColumn("seq", F.row_number().over(Window.partitionBy("split", "unit_id").orderBy(*order)).cast("long"))
    by_column = ordering.number_rows(shuffled, ["split", "unit_id"], order, F.floor(F.col("t") / 500))
    by_choice = ordering.number_rows(
        shuffled, ["split", "unit_id"], order, [F.floor(F.col("t") / 100_000), F.floor(F.col("t") / 900)], task_rows=50)
    same(plain, by_column)
    same(plain, by_choice)


def test_rows_without_order_value_are_numbered_first(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (1, 3)], "k int, t int")
    assert rows(ordering.number_rows(df, ["k"], ["t"], F.floor(F.col("t") / 4)).select("seq", "t"), "seq") == [(1, None), (2, 3), (3, 5)]


def test_a_hot_day_and_rows_without_time_are_split(spark):
    day = F.when(F.col("id") % 3 != 0, F.lit("2024-05-01 00:00:00").cast("timestamp"))
    df = spark.range(3_000).select(F.lit(1).alias("k"), day.alias("ts"), (F.col("id") * 7 % 3_000).alias("event_id"))
    buckets = ordering.order_buckets("ts", "event_id")
    chosen = ordering.pick_bucket(df, buckets, task_rows=300)
    longest = df.groupBy(F.struct(chosen.alias("b"))).count().agg(F.max("count")).first()[0]
    assert longest <= 300
    plain = df.withColumn("seq", F.row_number().over(Window.partitionBy("k").orderBy("ts", "event_id")).cast("long"))
    same(plain, ordering.number_rows(df, ["k"], ["ts", "event_id"], buckets, task_rows=300), keys=("k", "seq"))


def test_bucket_choice_is_bounded(trajectories):
    coarse, fine = F.floor(F.col("seq") / 500), F.floor(F.col("seq") / 10)
    assert ordering.pick_bucket(trajectories, [coarse, fine], task_rows=5_000) is coarse
    assert ordering.pick_bucket(trajectories, [coarse, fine], task_rows=700) is coarse
    assert ordering.pick_bucket(trajectories, [coarse, fine], task_rows=3) is fine


def test_a_hot_unit_is_spread_over_tasks(spark, trajectories):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hot = F.col("unit_id") == 1
        numbered = ordering.number_rows(
            trajectories.withColumnRenamed("seq", "t"), ["split", "unit_id"], ["t"], [F.floor(F.col("t") / 20)], task_rows=30)
        blocked = health.health_index(trajectories, block_rows=40)
        for df in (numbered, blocked):
            per_task = df.where(hot).groupBy(F.spark_partition_id()).count().collect()
            assert len(per_task) >= 5 and max(r["count"] for r in per_task) < 900 / 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("block", [5, 9, 64])
def test_blocks_equal_whole_trajectories(trajectories, block):
    whole = 1_000_000
    sensors = ["Xs_T48", "Xs_P2"]
    same(prepare.rolling_features(trajectories, sensors, block_rows=block), prepare.rolling_features(trajectories, sensors, block_rows=whole))
    same(anomaly.early_warning(trajectories, block_rows=block), anomaly.early_warning(trajectories, block_rows=whole))
    index = health.health_index(trajectories, block_rows=block)
    same(index, health.health_index(trajectories, block_rows=whole))
    same(health.raw_trends(index, block_rows=block), health.raw_trends(index, block_rows=whole))
    same(reasoning.temporal_features(index, block_rows=block), reasoning.temporal_features(index, block_rows=whole))
    res = residuals.residuals(
        trajectories.withColumns({f"ensemble_predicted_{s}": F.lit(0.5) for s in sensors}), sensors)
    same(residuals.residual_features(res, sensors, block_rows=block), residuals.residual_features(res, sensors, block_rows=whole))


@pytest.mark.parametrize("block", [19, 50])
def test_sequence_blocks(trajectories, block):
    a = prepare.sequences(trajectories, ["Xs_T48"], block_rows=block)
    b = prepare.sequences(trajectories, ["Xs_T48"], block_rows=1_000_000)
    assert a.count() == b.count() == (900 - 19) + (37 - 19) + (120 - 19)
    same(a.withColumn("sequence", F.to_json("sequence")), b.withColumn("sequence", F.to_json("sequence")))
    i = prepare.sequence_index(trajectories, stride=4, block_rows=block)
    j = prepare.sequence_index(trajectories, stride=4, block_rows=1_000_000)
    same(i, j, keys=("split", "unit_id", "end_row_index"))


def test_block_shorter_than_look_back_is_refused(trajectories):
    with pytest.raises(ValueError):
        ordering.in_blocks(trajectories, 5, lambda df, w: df, block_rows=4)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1), min_size=1, max_size=40), st.integers(5, 12))
def test_early_warning_any_scores(spark, scores, block):
    df = spark.createDataFrame([("dev", 1, i + 1, float(s)) for i, s in enumerate(scores)], "split string, unit_id int, seq long, final_anomaly_score double")
    out = anomaly.early_warning(df, block_rows=block).orderBy("seq").collect()
    slopes = [0.0] + [b - a for a, b in zip(scores, scores[1:])]
    for i, r in enumerate(out):
        lo = max(0, i - 4)
        mean = sum(scores[lo:i + 1]) / (i + 1 - lo)
        slope = max(0.0, min(1.0, sum(slopes[lo:i + 1]) / (i + 1 - lo)))
        assert abs(r["early_warning_score"] - min(1.0, 0.7 * mean + 0.3 * slope)) < 1e-9


def test_occurrence_join_is_one_to_one(spark):
    left = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3), ("m", 1)], "key string, seq long")
    right = spark.createDataFrame([("k", 5, "x"), ("k", 9, "y")], "key string, seq long, v string")
    for block_rows in (2, 1_000):
        out = ordering.occurrence_join(left, right, ["key"], block_rows=block_rows)
        assert rows(out.select("key", "seq", "v"), "key", "seq") == [("k", 1, "x"), ("k", 2, "y"), ("k", 3, None), ("m", 1, None)]


def test_lookup_beyond_the_bound_is_a_shuffle_join(spark):
    big = spark.range(100).withColumn("v", F.col("id") * 2)
    a = ordering.lookup_join(spark.range(100), big, ["id"], max_rows=1_000)
    b = ordering.lookup_join(spark.range(100), big, ["id"], max_rows=10)
    assert "BroadcastHashJoin" in a._jdf.queryExecution().executedPlan().toString()
    assert sorted(a.collect()) == sorted(b.collect())
    assert ordering.small_table(big, 10) == (big, False)


def test_alignment(spark):
    a = spark.createDataFrame([("dev", 1, 1), ("dev", 1, 2)], "split string, unit_id int, seq int")
    b = spark.createDataFrame([("dev", 1, 1), ("dev", 1, 3)], "split string, unit_id int, seq int")
    ordering.require_aligned(a, a)
    found = ordering.alignment_audit(a, b).first()
    assert (found["left_only_keys"], found["right_only_keys"], found["aligned"]) == (1, 1, False)
    with pytest.raises(ValueError):
        ordering.require_aligned(a, b)


def test_sample_has_exact_size_and_is_stable(spark, trajectories):
    keys = ["split", "unit_id", "seq"]
    a = ordering.uniform_sample(trajectories, keys, 50)
    b = ordering.uniform_sample(trajectories.repartition(3), keys, 50)
    assert a.count() == 50
    same(a, b)
    assert ordering.uniform_sample(trajectories, keys, 10_000).count() == trajectories.count()


def test_short_keys_are_numbered_without_buckets(spark, trajectories):
    """Buckets of short keys would hold a few rows each, and the offsets be a table as long as the rows."""
    shuffled = trajectories.drop("seq").withColumn("t", F.col("cycle") * 1000 + F.abs(F.xxhash64("Xs_T48")) % 1000)
    shuffled = shuffled.unionByName(shuffled.limit(3).withColumn("unit_id", F.lit(None).cast("long")))
    numbered = ordering.number_rows(shuffled, ["split", "unit_id"], ["t", "Xs_T48"], [F.floor(F.col("t") / 900), F.col("t")])
    assert "Join" not in numbered._jdf.queryExecution().optimizedPlan().toString()
    w = Window.partitionBy("split", "unit_id").orderBy("t", "Xs_T48")
    plain = shuffled.withColumn("seq", F.when(F.col("unit_id").isNotNull(), F.row_number().over(w)).cast("long"))
    assert numbered.where("seq is null").count() == 3
    same(plain.where("seq is not null"), numbered.where("seq is not null"))
