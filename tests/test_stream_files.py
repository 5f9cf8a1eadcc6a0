"""What a stream leaves in its folder, and steps that run in several stretches."""

from __future__ import annotations

import pathlib

from pyspark.sql import functions as F

from fleetpulse.operators import health
from fleetpulse.streaming import tails
from fleetpulse.streaming.storage import shared_folder
from tests.conftest import same


def test_a_step_leaves_no_files_of_its_own_and_may_run_in_stretches(spark, trajectories, tmp_path, monkeypatch):
    """Rows come late, so that earlier ones are read back; the results are those of the batch operator."""
    rows = trajectories.withColumn("t", F.col("seq")).withColumn("id", F.col("unit_id") * 10_000 + F.col("seq"))
    part = F.least(F.floor(F.col("seq") / 400) + (F.col("seq") % 11 == 0).cast("int"), F.lit(2))
    for k in range(3):
        rows.where(part == k).drop("seq").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sizes = []
    operator = lambda df: (sizes.append(df.count()), health.health_index(df))[1]
    want = health.health_index(rows).select("split", "unit_id", "t", "id", "seq", "health_index")
    for stretch in (1 << 20, 100):
        monkeypatch.setattr(tails, "STRETCH", stretch, raising=False)
        stream = tails.read_stream(spark, str(tmp_path / "in"), rows.drop("seq").schema, files_per_batch=1)
        job = tails.TailStream(operator, ["t", "id"], F.floor(F.col("t") / 50), 4, shared_folder(spark), parts=4, columns=["health_index"])
        same(job.run(stream), want)
        folder = pathlib.Path(job.folder)
        left = {f.relative_to(folder).parts[0] for f in folder.rglob("*.parquet")}
        assert left == {"log", "late", "out", "state"}
    # three trajectories in four parts: some stretches have none
    assert len(sizes) > 6 and 0 in sizes[3:]
