from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import feedback

LABELS = ["accepted_alert", "rejected_false_alarm", "missed_anomaly", "uncertain"]


def replay(base, log):
    """The thresholds after applying the log one row at a time."""
    out = {k: list(v) for k, v in base.items()}
    for context, label in log:
        t = out[str(context)] if str(context) in out else out["global"]
        f = {"rejected_false_alarm": 1.02, "missed_anomaly": 0.98}.get(label, 1.0)
        t[:] = [max(x * f, 1e-9) for x in t]
        if t[0] > t[1]:
            t[1] = t[0] * 1.05
        if t[1] > t[2]:
            t[2] = t[1] * 1.05
    return out


@pytest.mark.parametrize("block", [1, 7, 65_536])
@pytest.mark.parametrize("labels", [LABELS, ["missed_anomaly"] * 30 + ["rejected_false_alarm"], LABELS[:2]])
def test_replay_in_blocks(spark, block, labels):
    rnd = random.Random(4)
    base = {"global": (1e-8, 0.5, 0.9), "0": (1.0, 2.0, 3.0), "1": (0.9, 0.2, 0.4), "2": (1.0, 1.0, 1.0)}
    log = [(rnd.choice([0, 1, 5, 0]), rnd.choice(labels)) for _ in range(400)]
    df = spark.createDataFrame([(i + 1, c, x) for i, (c, x) in enumerate(log)], "feedback_id long, context_id int, feedback_label string")
    t = spark.createDataFrame([(k, *map(float, v)) for k, v in base.items()], "context_id string, watch double, warning double, critical double")
    want = replay(base, log)
    for r in feedback.adapt_thresholds(t, df, block_rows=block).collect():
        for got, exp in zip((r["watch"], r["warning"], r["critical"]), want[r["context_id"]]):
            assert abs(got - exp) <= 1e-9 * max(1.0, abs(exp)) and (exp == 0 or abs(got / exp - 1) < 1e-6)


def test_named_example(spark):
    t = spark.createDataFrame([("global", 1.0, 2.0, 3.0)], "context_id string, watch double, warning double, critical double")
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(["rejected_false_alarm", "rejected_false_alarm", "missed_anomaly"])],
                               "feedback_id long, context_id int, feedback_label string")
    assert abs(feedback.adapt_thresholds(t, df).first()["watch"] - 1.019592) < 1e-12


def test_latest_and_memory(spark):
    log = spark.createDataFrame([(1, "1", 5, 0, "accepted_alert"), (3, "1", 5, 0, "missed_anomaly"), (2, "1", 5, 0, "uncertain"), (4, "bad", 5, 0, "uncertain")],
                                "feedback_id long, unit_id string, cycle int, context_id int, feedback_label string")
    latest = feedback.latest_feedback(log)
    assert [tuple(r) for r in latest.collect()] == [(1, 5, 0, "missed_anomaly")]
    rows = spark.createDataFrame([(1, 5, "dev", 0, "Watch", 0.5), (1, 6, "dev", 0, "Critical", float("nan")), (1, 7, "dev", None, "Normal", 0.1)],
                                 "unit_id long, cycle int, split string, gmm_context_id int, alert_level string, final_anomaly_score double")
    memory = feedback.alert_memory(rows, latest).orderBy("cycle").collect()
    assert [(r["cycle"], r["final_anomaly_score"], r["feedback_status"], r["top_sensor_1"]) for r in memory] == [
        (5, 0.5, "missed_anomaly", "unknown"), (6, 0.0, "no_feedback", "unknown")]


def test_store_appends_and_numbers(spark, tmp_path):
    def record(cycle, label="accepted_alert"):
        return spark.createDataFrame([(cycle, 1, cycle, 0, "Watch", 0.5, "p", label)],
                                     "t int, unit_id long, cycle int, context_id int, alert_level string, final_anomaly_score double, root_cause_pattern string, feedback_label string")

    path = str(tmp_path / "log")
    feedback.store_feedback(spark, path, record(3), ["t"], F.col("t"))
    log = feedback.store_feedback(spark, path, record(1), ["t"], F.col("t"))
    assert [(r["feedback_id"], r["cycle"], r["feedback_status"]) for r in log.orderBy("feedback_id").collect()] == [(1, 3, "stored"), (2, 1, "stored")]
    with pytest.raises(ValueError):
        feedback.store_feedback(spark, path, record(2, "nonsense"), ["t"], F.col("t"))


def test_states_of_stretches_combine(spark):
    """A replay in one go, and in stretches whose states are combined one after the other."""
    rnd = random.Random(9)
    base = {"global": (1e-8, 0.5, 0.9), "0": (1.0, 2.0, 3.0), "1": (0.9, 0.2, 0.4)}
    t = spark.createDataFrame([(k, *map(float, v)) for k, v in base.items()], "context_id string, watch double, warning double, critical double")
    log = [(i + 1, rnd.choice([0, 1, 5, None]), rnd.choice(LABELS)) for i in range(300)]
    df = spark.createDataFrame(log, "feedback_id long, context_id int, feedback_label string")
    state = None
    for lo, hi in ((0, 1), (1, 1), (1, 120), (120, 300)):  # the second one is empty
        part = feedback.replay_state(t, df.where((F.col("feedback_id") > lo) & (F.col("feedback_id") <= hi)), block_rows=16).withColumn("at", F.lit(1))
        both = part if state is None else state.withColumn("at", F.lit(0)).unionByName(part)
        state = spark.createDataFrame(feedback.combined(both, "at").collect(), feedback.combined(both, "at").schema)
    want = {r["context_id"]: tuple(r)[1:] for r in feedback.adapt_thresholds(t, df).collect()}
    got = {r["context_id"]: tuple(r)[1:] for r in feedback.apply_state(t, state).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert state.agg(F.max("last")).first()[0] == 300


def test_batches_keep_their_ids_and_writers_don_t_share_them(spark, tmp_path):
    def records(*cycles):
        return spark.createDataFrame([(c, 1, c, 0, "Watch", 0.5, "p", "accepted_alert") for c in cycles],
                                     "t int, unit_id long, cycle int, context_id int, alert_level string, final_anomaly_score double, root_cause_pattern string, feedback_label string")

    path = str(tmp_path / "log")
    feedback.store_feedback(spark, path, records(1, 2), ["t"], F.col("t"), "b")
    feedback.store_feedback(spark, path, records(3), ["t"], F.col("t"), "c")
    again = feedback.store_feedback(spark, path, records(1, 2), ["t"], F.col("t"), "b")
    assert sorted((r["feedback_id"], r["cycle"]) for r in again.collect()) == [(1, 1), (2, 2), (3, 3)]
    # another writer took the ids 4 and 5 at the same time and stored them under a smaller name
    feedback.number_feedback(records(8, 9), 3, ["t"], F.col("t")).write.parquet(f"{path}/batch=a")
    feedback.number_feedback(records(5, 6), 3, ["t"], F.col("t")).write.parquet(f"{path}/batch=d")
    log = feedback.store_feedback(spark, path, records(5, 6), ["t"], F.col("t"), "d")
    ids = sorted((r["feedback_id"], r["cycle"]) for r in log.collect())
    assert ids == [(1, 1), (2, 2), (3, 3), (4, 8), (5, 9), (6, 5), (7, 6)]
    assert {r["feedback_status"] for r in feedback.mark_used(log, 3).where("feedback_id > 3").collect()} == {"stored"}
    assert {r["feedback_status"] for r in feedback.mark_used(log).collect()} == {feedback.USED}
