"""Streams fed in several micro-batches give the batch results."""

from __future__ import annotations

import uuid

import pytest
from conftest import same
from pyspark.sql import functions as F

from fleetpulse.operators import anomaly, feedback, health, prepare, reasoning, residuals
from fleetpulse.streaming import tails
from fleetpulse.streaming.storage import shared_folder

ORDER = ["t", "id"]


@pytest.fixture(scope="module")
def parts(spark, trajectories, tmp_path_factory):
    """The trajectories as four files in time order."""
    folder = str(tmp_path_factory.mktemp("parts"))
    df = trajectories.withColumn("t", F.col("seq")).withColumn("id", F.col("unit_id") * 10_000 + F.col("seq"))
    for i, (lo, hi) in enumerate(((0, 3), (3, 40), (40, 500), (500, 9_999))):
        df.where((F.col("seq") > lo) & (F.col("seq") <= hi)).drop("seq").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{i}")
    files = f"{folder}/all"
    for i in range(4):
        spark.read.parquet(f"{folder}/{i}").coalesce(1).write.mode("append").parquet(files)
    return files


def run(spark, parts, operator, tail, keep=None):
    schema = spark.read.parquet(parts).schema
    stream = tails.read_stream(spark, parts, schema, files_per_batch=1)
    job = tails.TailStream(operator, ORDER, F.floor(F.col("t") / 50), tail, shared_folder(spark), keep=keep)
    return job, job.run(stream)


def base(trajectories):
    return trajectories.withColumn("t", F.col("seq")).withColumn("id", F.col("unit_id") * 10_000 + F.col("seq"))


def test_trailing_operators(spark, parts, trajectories):
    cases = [
        (anomaly.early_warning, 5),
        (lambda d: health.raw_trends(health.health_index(d)), 9),
        (lambda d: reasoning.temporal_features(health.health_index(d)), 8),
        (lambda d: residuals.residual_features(residuals.residuals(d.withColumn("ensemble_predicted_Xs_T48", F.lit(0.1)), ["Xs_T48"]), ["Xs_T48"]), 4),
        (lambda d: prepare.sequences(d, ["Xs_T48"], 6, keep_short=True).withColumn("sequence", F.to_json("sequence")), 5),
    ]
    for operator, tail in cases:
        job, got = run(spark, parts, operator, tail)
        batches = spark.read.option("basePath", job.output).parquet(job.output).select("batch").distinct().count()
        assert batches == 4
        same(got, operator(base(trajectories)))


def test_recurrence(spark, parts, trajectories):
    op = lambda d: reasoning.recurrence(d, lookback=6)
    _, got = run(spark, parts, op, 1, tails.recent_cycles(6))
    same(got, op(base(trajectories)))


def test_a_repeated_batch_changes_nothing(spark, parts):
    job, got = run(spark, parts, health.health_index, 4)
    before = spark.createDataFrame(got.toPandas(), got.schema)
    last = spark.read.parquet(parts).where("t > 500")
    job.step(last, 3)
    job.step(last, 3)
    same(job.result(spark), before)


@pytest.mark.parametrize("operator, tail, keep", [
    (anomaly.early_warning, 5, None),
    (lambda d: health.raw_trends(health.health_index(d)), 9, None),
    (lambda d: reasoning.recurrence(d, lookback=6), 1, tails.recent_cycles(6)),
])
def test_rows_in_any_order_of_arrival(spark, trajectories, tmp_path, operator, tail, keep):
    """Five batches: a trajectory is silent in some, and rows come up to three batches late."""
    late = F.when(F.col("seq") % 11 == 0, F.col("seq") % 4).otherwise(0)
    silent = F.when((F.col("unit_id") == 2) & (F.col("seq") > 5), 2).otherwise(0)
    rows = base(trajectories).withColumn("part", F.least(F.floor(F.col("seq") / 250) + late + silent, F.lit(4)))
    schema = rows.drop("seq", "part").schema
    for k in range(5):
        rows.where(F.col("part") == k).drop("seq", "part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = tails.read_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    job = tails.TailStream(operator, ORDER, F.floor(F.col("t") / 50), tail, shared_folder(spark), keep=keep, snapshot=2)
    same(job.run(stream), operator(base(trajectories)))
    assert spark.read.option("basePath", job.output).parquet(job.output).select("batch").distinct().count() == 5
    # the tails of a batch are those of its own trajectories, but for every second one
    state = spark.read.option("basePath", f"{job.folder}/state").parquet(f"{job.folder}/state")
    units = {r.batch: r.n for r in state.groupBy("batch").agg(F.count_distinct("split", "unit_id").alias("n")).collect()}
    assert units[2] == 3 and units[4] == 3


def test_a_late_row_runs_only_what_follows_it(spark, parts, trajectories):
    job, got = run(spark, parts, health.health_index, 4)
    n = got.count()
    job.step(spark.read.parquet(parts).where("unit_id = 1 and t = 880").withColumn("t", F.col("t").cast("long")).withColumn("id", F.lit(1).cast("long")), 4)
    again = spark.read.parquet(f"{job.output}/batch=4")
    assert again.where("unit_id <> 1").count() == 0 and again.count() == 900 - 880 + 2 and job.result(spark).count() == n + 1
    assert job.result(spark).where("unit_id = 1").agg(F.max("seq"), F.count_distinct("seq")).first() == (901, 901)


def test_row_wise_scoring(spark, parts, trajectories):
    t = spark.createDataFrame([("global", 0.5, 1.0, 2.0)], "context_id string, watch double, warning double, critical double")
    folder = shared_folder(spark)
    score = lambda d: anomaly.score_residuals(d.withColumn("gmm_context_id", F.lit(1)), t, "Xs_T48")
    stream = tails.read_stream(spark, parts, spark.read.parquet(parts).schema, files_per_batch=1)
    tails.append_scores(stream, score, folder).awaitTermination()
    same(spark.read.parquet(f"{folder}/out"), score(spark.read.parquet(parts)), keys=("id",))


def test_feedback_stream(spark, tmp_path):
    t = spark.createDataFrame([("global", 1.0, 2.0, 3.0), ("0", 1.0, 2.0, 3.0)], "context_id string, watch double, warning double, critical double")
    data = [(i, 1, i, i % 2, "Watch", 0.5, "p", ["rejected_false_alarm", "missed_anomaly", "rejected_false_alarm"][i % 3]) for i in range(30)]
    df = spark.createDataFrame(data, "t long, unit_id long, cycle int, context_id int, alert_level string, final_anomaly_score double, root_cause_pattern string, feedback_label string")
    folder = str(tmp_path / uuid.uuid4().hex)
    for lo in (0, 10, 20):
        df.where((F.col("t") >= lo) & (F.col("t") < lo + 10)).coalesce(1).write.mode("append").parquet(folder)
    stream = tails.read_stream(spark, folder, df.schema, files_per_batch=1)
    got = tails.FeedbackStream(t, ["t"], F.floor(F.col("t") / 4), shared_folder(spark)).run(stream)
    log = feedback.number_feedback(df, 0, ["t"], F.floor(F.col("t") / 4))
    same(got, feedback.adapt_thresholds(t, log), keys=("context_id",))


def test_cluster_needs_a_shared_folder(spark):
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_only_named_columns_are_written_and_late_runs_are_noted(spark, parts, trajectories):
    stream = tails.read_stream(spark, parts, spark.read.parquet(parts).schema, files_per_batch=1)
    job = tails.TailStream(health.health_index, ORDER, F.floor(F.col("t") / 50), 4, shared_folder(spark), columns=["health_index"])
    want = health.health_index(base(trajectories)).select("split", "unit_id", *ORDER, "seq", "health_index")
    same(job.run(stream), want)
    # rows that come twice, one of them in place of a processed one: the last version of every row stays
    more = spark.read.parquet(parts).where("unit_id = 1 and t in (300, 700)").withColumn("final_anomaly_score", F.lit(1.0))
    job.step(more.where("t = 700"), 4)
    job.step(more.where("t = 300"), 5)
    job.step(more.where("t = 300"), 5)
    new = base(trajectories).withColumn("final_anomaly_score", F.when(F.expr("unit_id = 1 and t in (300, 700)"), 1.0).otherwise(F.col("final_anomaly_score")))
    same(job.result(spark), health.health_index(new).select(*want.columns))
    notes = spark.read.option("basePath", f"{job.folder}/late").parquet(f"{job.folder}/late").select("batch", "unit_id", "_from.t").orderBy("batch").collect()
    assert [tuple(r) for r in notes] == [(4, 1, 700), (5, 1, 300)]
