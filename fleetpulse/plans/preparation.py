"""Queries A-D: sources, cleaning, trajectory features, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions import channels
from fleetpulse.operators import prepare, residuals
from fleetpulse.plans import inputs
from fleetpulse.plans.registry import query
from fleetpulse.plans.sql import W, W5, each
from fleetpulse.sources import tables
from fleetpulse.streaming.storage import shared_folder

S4 = inputs.SENSORS


@query("A1", "split", "l_suppkey n", "qty",
       sql="SELECT CASE l_linestatus WHEN 'F' THEN 'dev' ELSE 'test' END AS split, l_suppkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL")
def load_both_splits(spark: SparkSession, sf: str) -> DataFrame:
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    both = tables.stack_splits({
        "dev": line.where(F.col("l_linestatus") == "F"), "test": line.where(F.col("l_linestatus") != "F")})
    return both.groupBy("split", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("A2", "split", "unit_id seq A_event_id", "W_value Xs_value Xv_1 Xv_2",
       sql="SELECT split, unit_id, seq, event_id AS A_event_id, Xs_T48/2 AS W_value, Xs_T48 AS Xs_value, Xs_T48*2 AS Xv_1, Xs_T48*3 AS Xv_2 FROM ev", tables=("ev",))
def assemble(spark: SparkSession, sf: str) -> DataFrame:
    ev = inputs.events(spark, sf)
    key = ["split", "unit_id", "seq"]
    groups = {
        "A": ev.select(*key, "event_id"),
        "W": ev.select(*key, (F.col("Xs_T48") / 2).alias("value")),
        "X_s": ev.select(*key, F.col("Xs_T48").alias("value")),
        "X_v": ev.select(*key, (F.col("Xs_T48") * 2).alias("a"), (F.col("Xs_T48") * 3).alias("b")),
    }
    names = {"A": ["event id"], "W": ["W_value"], "X_s": ["value"]}
    return tables.assemble_groups(groups, key, names)


@query("A3", "Xs_order_status", "o_orderkey", "Xs_total_price",
       sql="SELECT o_orderkey, o_orderstatus AS Xs_order_status, o_totalprice AS Xs_total_price FROM orders")
def rename_channels(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return channels.name_channels(df, "Xs", ["order status", "total-price"], keep=["o_orderkey"])


@query("A4", "", "unit_id n", "Xs_sum",
       sql="SELECT l_suppkey AS unit_id, count(*) AS n, sum(l_quantity) AS Xs_sum FROM lineitem GROUP BY ALL")
def validated_groups(spark: SparkSession, sf: str) -> DataFrame:
    channels.check_groups(["A", "W", "X_s", "X_v", "Y"])
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_suppkey").alias("unit_id"), F.col("l_quantity").alias("Xs_T48"), F.col("l_tax").alias("Y_rul"))
    df = channels.drop_targets(df)
    channels.require_columns(df, ["unit_id", "Xs_T48"])
    if "Y_rul" in df.columns:
        raise ValueError("target column survived")
    return df.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.sum("Xs_T48").alias("Xs_sum"))


@query("A5", "", "event_id unit_id cycle",
       sql="""SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 1 ELSE user_id END AS unit_id,
       row_number() OVER (PARTITION BY CASE WHEN event_id % 17 = 0 THEN 1 ELSE user_id END ORDER BY event_id) AS cycle FROM events""")
def inferred_keys(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id"), F.when(F.col("event_id") % 17 == 0, F.lit("unknown")).otherwise(F.col("user_id").cast("string")).alias("engine"),
        F.col("value").alias("Xs_T48"))
    df = df.select("engine", "event_id", "Xs_T48")
    return tables.add_unit_and_cycle(df, "event_id", rows_per_bucket=1_024)


@query("A6", "o_orderpriority", "o_orderkey", "o_totalprice",
       sql="SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def projected(spark: SparkSession, sf: str) -> DataFrame:
    return channels.project(spark.read.parquet(f"{sf}/orders.parquet"), ["o_orderkey", "o_totalprice"], ["o_orderpriority", "not_there"])


@query("A7", "split", "unit_id event_id cycle", "Xs_T48", sql="SELECT * FROM ev0", tables=("ev0",))
def written_stage(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    tables.write_stage(tables.events_telemetry(spark, sf, sequenced=False), path, partition_by=["split"])
    return tables.read_required(spark, path)


@query("A8", "o_orderstatus", "o_orderkey", "o_totalprice", sql="SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def read_csv_stage(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    tables.write_stage(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, "csv")
    return tables.read_required(spark, path, "csv", "o_orderkey long, o_orderstatus string, o_totalprice double")


@query("A9", "sensor", "n", "mean",
       sql="SELECT sensor, count(*) AS n, avg(v) AS mean FROM (UNPIVOT (SELECT Xs_T48, Xs_Ps30, Xs_Nf, Xs_Wf FROM li) ON COLUMNS(*) INTO NAME sensor VALUE v) GROUP BY sensor", tables=("li",))
def selected_sensors(spark: SparkSession, sf: str) -> DataFrame:
    li = tables.lineitem_telemetry(spark, sf, sequenced=False).withColumns({
        "Xs_T48_rolling_mean_5": F.lit(1.0), "Xs_Nf_trend": F.lit(0.0)})
    names = channels.raw_sensors(li)
    return li.agg(*[F.count(n).alias(f"{n}__n") for n in names], *[F.avg(n).alias(f"{n}__m") for n in names]).select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("sensor"), F.col(f"{n}__n").alias("n"), F.col(f"{n}__m").alias("mean")) for n in names])))


@query("B1", "split", "event_id", "Xs_T48", sql="SELECT event_id, split, Xs_T48 FROM gap", tables=("gap",))
def without_infinities(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.infinite_to_null(inputs.gappy_events(spark, sf))


@query("B2", "split", "event_id unit_id cycle",
       sql="SELECT event_id, split, coalesce(TRY_CAST(unit_id AS BIGINT), 1) AS unit_id, coalesce(TRY_CAST(cycle AS BIGINT), 0) AS cycle FROM gap", tables=("gap",))
def coerced_keys(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.coerce_metadata(inputs.gappy_events(spark, sf))


@query("B3", "split", "event_id", "Xs_T48 Xs_P2 Xs_Nf", sql="SELECT event_id, split, Xs_T48, Xs_P2, Xs_Nf FROM gap2", tables=("gap2",))
def imputed_numbers(spark: SparkSession, sf: str) -> DataFrame:
    df = prepare.infinite_to_null(inputs.gappy_events(spark, sf))
    return prepare.impute_numeric(df, ["Xs_T48", "Xs_P2", "Xs_Nf", "W_alt"])


@query("B4", "event_type", "event_id", sql="SELECT event_id, coalesce(event_type, 'unknown') AS event_type FROM gap", tables=("gap",))
def imputed_text(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.impute_text(inputs.gappy_events(spark, sf), ["event_type"])


@query("B5", "column_name is_constant", "", "low high",
       sql="""SELECT 'Xs_T48' AS column_name, min(Xs_T48) AS low, max(Xs_T48) AS high, coalesce(min(Xs_T48) = max(Xs_T48), true) AS is_constant FROM gap2
       UNION ALL SELECT 'Xs_Nf', min(Xs_Nf), max(Xs_Nf), coalesce(min(Xs_Nf) = max(Xs_Nf), true) FROM gap2
       UNION ALL SELECT 'W_alt', min(W_alt), max(W_alt), coalesce(min(W_alt) = max(W_alt), true) FROM gap2""", tables=("gap2",))
def constants(spark: SparkSession, sf: str) -> DataFrame:
    df = prepare.impute_numeric(prepare.infinite_to_null(inputs.gappy_events(spark, sf)), ["Xs_T48", "Xs_Nf"])
    return prepare.constant_columns(df, ["Xs_T48", "Xs_Nf", "W_alt"])


@query("B6", "split event_type", "event_id unit_id cycle", "Xs_T48 Xs_P2",
       sql="""SELECT event_id, split, coalesce(event_type, 'unknown') AS event_type, coalesce(TRY_CAST(unit_id AS BIGINT), 1) AS unit_id,
       coalesce(TRY_CAST(cycle AS BIGINT), 0) AS cycle, Xs_T48, Xs_P2 FROM gap2""", tables=("gap2",))
def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.clean(inputs.gappy_events(spark, sf))


@query("C1", "split", "unit_id seq trajectory_index event_id",
       sql="SELECT split, unit_id, seq, event_id, seq - 1 AS trajectory_index FROM ev", tables=("ev",))
def trajectory_index(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.add_trajectory_index(inputs.events(spark, sf))


def _rolled(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.rolling_features(tables.lineitem_telemetry(spark, sf), S4)


def _names(i: int) -> str:
    return " ".join(prepare.rolling_names(s)[i] for s in S4)


@query("C2", "split", "unit_id seq", _names(0), tables=("li",),
       sql="SELECT split, unit_id, seq, " + each(f"avg({{s}}) OVER {W5} AS {{s}}_rolling_mean_5") + " FROM li")
def rolling_means(spark: SparkSession, sf: str) -> DataFrame:
    return _rolled(spark, sf)


@query("C3", "split", "unit_id seq", _names(1), tables=("li",),
       sql="SELECT split, unit_id, seq, " + each(f"coalesce(stddev_samp({{s}}) OVER {W5}, 0.0) AS {{s}}_rolling_std_5") + " FROM li")
def rolling_deviations(spark: SparkSession, sf: str) -> DataFrame:
    return _rolled(spark, sf)


@query("C4", "split", "unit_id seq", _names(2), tables=("li",),
       sql="SELECT split, unit_id, seq, " + each(f"coalesce({{s}} - lag({{s}}) OVER ({W}), 0.0) AS {{s}}_trend") + " FROM li")
def first_differences(spark: SparkSession, sf: str) -> DataFrame:
    return _rolled(spark, sf)


@query("C5", "split", "event_id", "Xs_T48 Xs_P2 Xs_Nf", tables=("gap",),
       sql="SELECT event_id, split, coalesce(Xs_T48, 0.0) AS Xs_T48, coalesce(Xs_P2, 0.0) AS Xs_P2, 0.0 AS Xs_Nf FROM gap")
def zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.zero_fill(inputs.gappy_events(spark, sf))


@query("C6", "split", "unit_id sequence_start_cycle sequence_end_cycle start_row_index end_row_index window_size stride", tables=("li",),
       sql=f"""SELECT * FROM (SELECT split, unit_id, lag(cycle, 19) OVER ({W}) AS sequence_start_cycle, cycle AS sequence_end_cycle,
       lag(seq, 19) OVER ({W}) AS start_row_index, seq AS end_row_index, 20 AS window_size, 3 AS stride FROM li) WHERE start_row_index IS NOT NULL AND (start_row_index - 1) % 3 = 0""")
def windows(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.sequence_index(tables.lineitem_telemetry(spark, sf), stride=3)


@query("C7", "split", "unit_id seq n", "first_value last_value total", tables=("ev",),
       sql=f"""SELECT * FROM (SELECT split, unit_id, seq, 40 AS n, lag(Xs_T48, 19) OVER ({W}) AS first_value, gmm_context_id AS last_value,
       sum(Xs_T48 + gmm_context_id) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS total FROM ev) WHERE seq >= 20""")
def sequences(spark: SparkSession, sf: str) -> DataFrame:
    df = prepare.sequences(inputs.events(spark, sf), ["Xs_T48", "gmm_context_id"])
    return df.withColumns({
        "n": F.size("sequence"), "first_value": F.col("sequence")[0], "last_value": F.col("sequence")[39],
        "total": F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x)})


D1_ROLLING = each(
    f"avg({{s}}) OVER {W5} AS {{s}}_rolling_mean_5, coalesce(stddev_samp({{s}}) OVER {W5}, 0.0) AS {{s}}_rolling_std_5, "
    f"coalesce({{s}} - lag({{s}}) OVER ({W}), 0.0) AS {{s}}_trend")


@query("D1", "column_name", "n", "mean", tables=("li",),
       sql=f"""SELECT column_name, count(*) AS n, avg(v) AS mean FROM (UNPIVOT (SELECT CAST(seq - 1 AS DOUBLE) AS trajectory_index, Xs_T48, Xs_Ps30, Xs_Nf, Xs_Wf, {D1_ROLLING} FROM li) ON COLUMNS(*) INTO NAME column_name VALUE v) GROUP BY column_name""")
def scalable(spark: SparkSession, sf: str) -> DataFrame:
    df = prepare.engineer(tables.lineitem_telemetry(spark, sf), S4)
    names = channels.scalable_columns(df)
    return df.agg(*[F.count(n).alias(f"{n}__n") for n in names], *[F.avg(n).alias(f"{n}__m") for n in names]).select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"{n}__n").alias("n"), F.col(f"{n}__m").alias("mean")) for n in names])))


@query("D2", "split", "unit_id seq", " ".join(S4), sql="SELECT * FROM liz", tables=("liz",))
def scaled(spark: SparkSession, sf: str) -> DataFrame:
    scaler = prepare.fit_standardizer(tables.lineitem_telemetry(spark, sf, sequenced=False), S4)
    return scaler.transform(tables.lineitem_telemetry(spark, sf))


RESFEAT = " ".join(residuals.residual_feature_names("Xs_T48"))


@query("D3", "split", "unit_id seq", "residual_Xs_T48 " + RESFEAT.split()[0], tables=("res",),
       sql=f"""WITH f AS (SELECT split, unit_id, seq, residual_Xs_T48 AS a, avg(residual_Xs_T48) OVER {W5} AS b FROM res),
       s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM f WHERE split = 'dev')
       SELECT split, unit_id, seq, (a - ma)/sa AS residual_Xs_T48, (b - mb)/sb AS {RESFEAT.split()[0]} FROM f, s""")
def scaled_residual_features(spark: SparkSession, sf: str) -> DataFrame:
    df = residuals.residual_features(inputs.fit_lineitem(spark, sf).residuals(), ["Xs_T48"])
    return prepare.standardize(df, ["residual_Xs_T48", RESFEAT.split()[0]])
