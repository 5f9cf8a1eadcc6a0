"""Root cause ranking, pattern rules, recurrence and temporal reasoning."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetpulse.functions.exprs import clip, col, finite_or, fixed, fmt, label_map, unit_clip
from fleetpulse.operators.ordering import difference, in_blocks, trailing
from fleetpulse.settings import BLOCK_ROWS, LOOKBACK_CYCLES, NO_MAINTENANCE, ROLLING_ROWS, SEQ, TRAJECTORY

# Name parts that place a sensor in a family, for pattern rules.
FAMILY_TOKENS = {
    "temperature": ("temp", "temperature", "t2", "t24", "t30", "t40", "t48", "t50"),
    "pressure": ("press", "pressure", "p2", "p15", "p21", "p24", "p30", "ps30", "p40", "p45", "p50"),
    "flow": ("flow", "fuel", "wf", "w21", "w22", "w25", "w31", "w32", "w48", "w50"),
    "rotation": ("speed", "shaft", "n1", "n2", "nf", "nc", "nrf", "nrc"),
    "efficiency": ("eff", "efficiency", "epr", "bpr"),
    "hot_section": ("t48", "t50"),
    "core_pressure": ("ps30", "p40", "p50", "p30", "p45"),
}

# Pattern rules; the first whose families are all present applies.
PATTERN_RULES = (
    (("hot_section", "core_pressure"), "hot_section_pressure_thermal_deviation"),
    (("temperature", "pressure", "rotation"), "thermal_pressure_rotational_coupled_deviation"),
    (("temperature", "pressure"), "temperature_pressure_instability"),
    (("flow", "temperature"), "flow_thermal_response_deviation"),
    (("flow", "pressure"), "flow_pressure_response_deviation"),
    (("rotation", "pressure"), "rotational_pressure_deviation"),
    (("rotation", "temperature"), "rotational_thermal_response_deviation"),
    (("temperature",), "thermal_response_deviation"),
    (("pressure",), "pressure_system_deviation"),
    (("flow",), "flow_or_fuel_related_deviation"),
    (("rotation",), "rotational_speed_deviation"),
    (("efficiency",), "efficiency_related_deviation"),
)
DEFAULT_PATTERN = "multisensor_residual_deviation"

# Inspection focus of each pattern.
DEFAULT_FOCUS = "Inspect the top contributing measured sensor channels."
PATTERN_FOCUS = {
    "hot_section_pressure_thermal_deviation":
        "Inspect hot-section temperature and pressure response consistency, especially HPT/LPT-related signal behavior.",
    "thermal_pressure_rotational_coupled_deviation":
        "Inspect coupled thermal, pressure, and rotational-speed signal behavior.",
    "temperature_pressure_instability":
        "Inspect thermal-pressure coupling and related measured sensor channels.",
    "flow_thermal_response_deviation":
        "Inspect fuel/flow signal consistency and thermal response behavior.",
    "flow_pressure_response_deviation":
        "Inspect fuel/flow signal consistency and pressure response behavior.",
    "rotational_pressure_deviation":
        "Inspect rotational-speed signal consistency and pressure response behavior.",
    "rotational_thermal_response_deviation":
        "Inspect rotational-speed signal consistency and thermal response behavior.",
    "thermal_response_deviation":
        "Inspect temperature response sensors and heat-related signal patterns.",
    "pressure_system_deviation":
        "Inspect pressure sensor behavior and compression-flow consistency.",
    "flow_or_fuel_related_deviation": "Inspect fuel-flow-related signal consistency.",
    "rotational_speed_deviation": "Inspect fan/core rotational-speed signal consistency.",
    "efficiency_related_deviation":
        "Inspect efficiency-related virtual/measured signal consistency.",
    "multisensor_residual_deviation": DEFAULT_FOCUS,
}

# Sentences.
SUMMARY_TEXT = (
    "The alert level is %s. Residual attribution suggests %s. The operating-vs-fault reasoning label is %s. "
    "Recommended inspection focus: %s This is an explanation and inspection-focus recommendation only, "
    "not a maintenance scheduling decision."
)
TEMPORAL_TEXT = (
    "Temporal pattern is %s. Recent anomaly persistence is %s. Anomaly score change is %s. "
    "Health index change from previous cycle is %s. Root-cause evidence suggests %s. "
    "This is reasoning support only, not a maintenance decision."
)
MEMBERSHIP_TEXT = "%s is grouped under the %s reasoning family."
MEMORY_TEXT = "Recent previous cycle count=%s within %s cycles."
GRAPH_ROLE = "Reasoning support and inspection-focus explanation"
ROOT_ROLE = "Root-cause sensor attribution and inspection focus"

# Families of the dependency graph, first match wins.
GRAPH_FAMILIES = {
    "Temperature": ("t2", "t24", "t30", "t40", "t48", "t50", "temp", "temperature"),
    "Pressure": ("p2", "p15", "p21", "p24", "p30", "ps30", "p40", "p45", "p50", "press", "pressure"),
    "Rotational": ("nf", "nc", "n1", "n2", "speed", "shaft"),
    "Fuel_Flow": ("wf", "fuel", "flow"),
    "Efficiency": ("eff", "epr", "bpr"),
}

# Source family, target family, kind, strength and note of each edge.
GRAPH_EDGES = (
    ("Fuel_Flow", "Temperature", "fuel_thermal_response_coupling", 0.75,
     "Fuel-flow changes can influence turbine temperature residual behavior."),
    ("Rotational", "Pressure", "shaft_pressure_coupling", 0.70,
     "Rotor-speed deviations can co-occur with compressor or turbine pressure residuals."),
    ("Pressure", "Temperature", "thermodynamic_coupling", 0.68,
     "Pressure and temperature residuals are coupled across gas-path operation."),
    ("Temperature", "Efficiency", "thermal_performance_indicator", 0.60,
     "Hot-section temperature residuals can support efficiency-loss reasoning."),
    ("Pressure", "Efficiency", "pressure_performance_indicator", 0.60,
     "Core pressure residuals can support performance-deviation reasoning."),
    ("Fuel_Flow", "Pressure", "fuel_pressure_response_coupling", 0.58,
     "Fuel-flow deviations may appear together with pressure response deviations."),
    ("Rotational", "Temperature", "shaft_thermal_response_coupling", 0.55,
     "Rotational-speed deviations may co-occur with thermal response deviations."),
)

_PREFIX = "abs_residual_|residual_|xs_|x_s_|xv_|x_v_"


def plain_sensor(c: str | Column) -> Column:
    """Sensor name in lower case without its family and residual prefixes."""
    return F.regexp_replace(F.lower(F.trim(col(c))), _PREFIX, "")


def rank_sensors(
    df: DataFrame,
    columns: Sequence[str],
    k: int,
    sensor_name: str = "top_sensor_{}",
    share_name: str = "contribution_{}",
    sum_name: str = "top3_contribution_sum",
    total_name: str = "total_abs_residual",
    decimals: int | None = 6,
) -> DataFrame:
    """The k sensors with the largest share of the absolute residual of each row.

    Equal shares keep column order. A row without residual, or with fewer sensors than
    k, is padded with ``none`` and 0.
    """
    sizes = [F.abs(finite_or(c, 0.0)) for c in columns]
    total = sum(sizes[1:], sizes[0])
    safe = F.greatest(total, F.lit(1e-12))
    entries = [
        F.struct((-(x / safe)).alias("neg"), F.lit(i).alias("pos"), F.lit(c.removeprefix("abs_residual_")).alias("sensor"))
        for i, (c, x) in enumerate(zip(columns, sizes))
    ]
    out = df.withColumn(total_name, total).withColumn("_ranked", F.sort_array(F.array(*entries)))
    empty = F.col(total_name) <= 1e-12
    cols: dict[str, Column] = {}
    shares: list[Column] = []
    for i in range(k):
        if i < len(columns):
            entry = F.col("_ranked")[i]
            cols[sensor_name.format(i + 1)] = F.when(empty, "none").otherwise(entry["sensor"])
            share = F.when(empty, F.lit(0.0)).otherwise(-entry["neg"])
        else:
            cols[sensor_name.format(i + 1)] = F.lit("none")
            share = F.lit(0.0)
        shares.append(share)
        cols[share_name.format(i + 1)] = share if decimals is None else F.round(share, decimals)
    together = sum(shares[1:], shares[0])
    cols[sum_name] = together if decimals is None else F.round(together, decimals)
    return out.withColumns(cols).drop("_ranked")


def families_of(sensor: str) -> list[str]:
    """Families of one sensor name."""
    name = re.sub(_PREFIX, "", sensor.strip().lower())
    return [f for f, tokens in FAMILY_TOKENS.items() if any(t in name for t in tokens)]


def add_family_flags(df: DataFrame, sensors: Sequence[str], known: Sequence[str] | None = None) -> DataFrame:
    """Per family, whether any of the named sensor columns belongs to it: ``has_<family>``.

    When the sensor names that can occur are known, families are resolved before the job
    and rows only compare names; otherwise the tokens are searched in every row.
    """
    if known is None:
        names = F.concat_ws("|", *[plain_sensor(s) for s in sensors])
        flags = {f: F.rlike("_names", F.lit("|".join(t))) for f, t in FAMILY_TOKENS.items()}
        out = df.withColumn("_names", names)
        return out.withColumns({f"has_{f}": c for f, c in flags.items()}).drop("_names")
    members = {f: [n for n in known if f in families_of(n)] for f in FAMILY_TOKENS}
    cols = {}
    for f, names in members.items():
        hit = F.lit(False)
        for s in sensors if names else ():
            hit = hit | F.col(s).isin(*names)
        cols[f"has_{f}"] = hit
    return df.withColumns(cols)


def root_cause_pattern() -> Column:
    """First rule whose family flags are all set."""
    out: Column | None = None
    for needed, pattern in PATTERN_RULES:
        cond = F.col(f"has_{needed[0]}")
        for f in needed[1:]:
            cond = cond & F.col(f"has_{f}")
        out = F.when(cond, pattern) if out is None else out.when(cond, pattern)
    return out.otherwise(DEFAULT_PATTERN)


def add_pattern(df: DataFrame, sensors: Sequence[str], known: Sequence[str] | None = None) -> DataFrame:
    """``root_cause_pattern`` and ``inspection_focus`` of the named sensor columns."""
    out = add_family_flags(df, sensors, known).withColumn("root_cause_pattern", root_cause_pattern())
    return out.drop(*[f"has_{f}" for f in FAMILY_TOKENS]).withColumn("inspection_focus", pattern_focus("root_cause_pattern"))


def pattern_focus(pattern: str | Column) -> Column:
    return label_map(pattern, PATTERN_FOCUS, DEFAULT_FOCUS)


def operating_or_fault(score: str, context_confidence: str, persistence: str) -> Column:
    """Is the anomaly more likely an operating change or a persistent fault."""
    s, c, p = F.col(score), F.col(context_confidence), F.col(persistence)
    lasting = p >= 0.40
    return (
        F.when(s < 0.40, "normal_operating_variation")
        .when((c < 0.50) & ~lasting, "possible_operating_context_shift")
        .when(lasting & (s >= 0.85), "critical_persistent_fault_related_pattern")
        .when(lasting & (s >= 0.65), "likely_fault_related_residual_pattern")
        .when(lasting, "persistent_watch_level_residual_pattern")
        .otherwise("watch_level_residual_pattern")
    )


def reasoning_summary(alert: str, pattern: str, score: str, context_confidence: str, persistence: str) -> Column:
    return fmt(SUMMARY_TEXT, alert, pattern, operating_or_fault(score, context_confidence, persistence), pattern_focus(pattern))


def root_cause(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Top three sensors, pattern and inspection focus; other columns pass through."""
    names = [c.removeprefix("abs_residual_") for c in columns]
    out = add_pattern(rank_sensors(df, columns, 3), ["top_sensor_1", "top_sensor_2", "top_sensor_3"], names)
    return out.withColumns({
        "maintenance_decision": F.lit(NO_MAINTENANCE),
        "component_role": F.lit(ROOT_ROLE),
    })


def graph_family(sensor: str | Column) -> Column:
    name = plain_sensor(sensor)
    out: Column | None = None
    for family, tokens in GRAPH_FAMILIES.items():
        cond = F.rlike(name, F.lit("|".join(tokens)))
        out = F.when(cond, family) if out is None else out.when(cond, family)
    return out.otherwise("Other")


def sensor_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per sensor that has at least one residual in the data."""
    seen = df.agg(*[F.count(c).alias(c) for c in columns])
    parts = [F.struct(F.lit(c.removeprefix("abs_residual_")).alias("sensor"), F.col(c).alias("rows")) for c in columns]
    return seen.select(F.inline(F.array(*parts))).where("rows > 0").select("sensor")


def dependency_graph(sensors: DataFrame) -> DataFrame:
    """Family edges with availability, then one membership row per sensor."""
    spark: SparkSession = sensors.sparkSession
    placed = sensors.select("sensor", graph_family("sensor").alias("family"))
    families = placed.groupBy("family").agg(
        F.concat_ws(", ", F.array_sort(F.collect_list("sensor"))).alias("names"),
        F.count(F.lit(1)).alias("n"),
    )
    edges = spark.createDataFrame(
        list(GRAPH_EDGES),
        "source_family string, target_family string, dependency_type string, dependency_strength double, reasoning_note string",
    )
    src = families.select(F.col("family").alias("source_family"), F.col("names").alias("_s"), F.col("n").alias("_sn"))
    dst = families.select(F.col("family").alias("target_family"), F.col("names").alias("_t"), F.col("n").alias("_tn"))
    between = edges.join(src, "source_family", "left").join(dst, "target_family", "left").select(
        F.lit("family_dependency").alias("edge_type"), "source_family", "target_family",
        F.coalesce("_s", F.lit("")).alias("source_sensors"), F.coalesce("_t", F.lit("")).alias("target_sensors"),
        F.col("_sn").isNotNull().alias("source_family_available"),
        F.col("_tn").isNotNull().alias("target_family_available"),
        (F.coalesce("_sn", F.lit(0)) + F.coalesce("_tn", F.lit(0))).cast("long").alias("available_sensor_count"),
        "dependency_type", "dependency_strength", "reasoning_note",
    )
    member = placed.select(
        F.lit("sensor_family_membership").alias("edge_type"),
        F.col("family").alias("source_family"), F.col("family").alias("target_family"),
        F.col("sensor").alias("source_sensors"), F.col("sensor").alias("target_sensors"),
        F.lit(True).alias("source_family_available"), F.lit(True).alias("target_family_available"),
        F.lit(1).cast("long").alias("available_sensor_count"),
        F.lit("sensor_family_membership").alias("dependency_type"), F.lit(1.0).alias("dependency_strength"),
        fmt(MEMBERSHIP_TEXT, "sensor", "family").alias("reasoning_note"),
    )
    return between.unionByName(member).withColumns({
        "hard_causal_claim": F.lit(False),
        "maintenance_decision": F.lit(NO_MAINTENANCE),
        "component_role": F.lit(GRAPH_ROLE),
    })


def graph_counts(graph: DataFrame) -> DataFrame:
    """Sensors per family and edges per dependency kind."""
    fam = graph.where(F.col("edge_type") == "sensor_family_membership").groupBy(F.col("source_family").alias("name")).count()
    dep = graph.where(F.col("edge_type") == "family_dependency").groupBy(F.col("dependency_type").alias("name")).count()
    return fam.select(F.lit("family").alias("kind"), "name", "count").unionByName(
        dep.select(F.lit("dependency").alias("kind"), "name", "count"))


def recurrence(
    df: DataFrame,
    pattern: str = "root_cause_pattern",
    lookback: int = LOOKBACK_CYCLES,
    keys: Sequence[str] = TRAJECTORY,
    cycle: str = "cycle",
    block_cycles: int = 4_096,
) -> DataFrame:
    """How many earlier cycles within ``lookback`` showed the same pattern.

    Rows are first reduced to distinct cycles per pattern, which are counted in blocks of
    cycles with the last cycles of the block before, then joined back.
    """
    seen = df.select(*keys, pattern, cycle).distinct()
    block = F.floor(F.col(cycle) / F.lit(block_cycles)).cast("long")
    near_end = F.pmod(F.col(cycle), F.lit(block_cycles)) >= F.lit(block_cycles - lookback)
    copies = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    w = Window.partitionBy(*keys, pattern, "_block").orderBy(cycle).rangeBetween(-lookback, -1)
    counts = (
        seen.withColumn("_block", F.explode(copies))
        .withColumn("similar_pattern_count_recent", F.count(F.lit(1)).over(w).cast("int"))
        .where(block == F.col("_block")).drop("_block")
    )
    n = F.col("similar_pattern_count_recent")
    status = F.when(n >= 2, "Recurring").when(n == 1, "Previously_Seen").otherwise("New_or_Isolated")
    return df.join(counts, [*keys, pattern, cycle], "left").withColumns({
        "similar_pattern_count_recent": F.coalesce(n, F.lit(0)),
    }).withColumns({
        "root_cause_recurrence_status": status,
        "root_cause_lookback_window": F.lit(lookback),
        "root_cause_memory_note": fmt(MEMORY_TEXT, n.cast("string"), F.lit(str(lookback))),
    })


def order_flag(df: DataFrame, keys: Sequence[str] = TRAJECTORY, seq: str = SEQ, cycle: str = "cycle", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per trajectory: number of rows whose cycle is below the row before, and a flag."""
    marked = in_blocks(df, 1, lambda x, w: x.withColumn("_back", F.coalesce((F.col(cycle) < F.lag(cycle).over(w)).cast("int"), F.lit(0))),
                       keys, seq, block_rows)
    return marked.groupBy(*keys).agg(F.sum("_back").cast("long").alias("out_of_order_rows")).withColumn(
        "root_cause_tracker_non_monotonic_cycle_flag",
        F.when(F.col("out_of_order_rows") > 0, "Check_Order").otherwise("OK"))


def temporal_pattern(score_delta: str, health_delta: str, persistence: str) -> Column:
    """Strongest matching pattern; stronger patterns are tested first."""
    a, h, p = F.col(score_delta), F.col(health_delta), F.col(persistence)
    return (
        F.when((p >= 0.80) & (h < -1.0), "Persistent_Deterioration")
        .when((a > 0.05) & (h < 0.0), "Increasing_Anomaly")
        .when(p >= 0.40, "Intermittent_Anomaly")
        .when((a < -0.05) & (h >= 0.0), "Recovering_Behaviour")
        .otherwise("Stable_Behaviour")
    )


def temporal_features(
    df: DataFrame,
    score: str = "final_anomaly_score",
    health: str = "health_index",
    rows: int = ROLLING_ROWS,
    threshold: float = 0.40,
    keys: Sequence[str] = TRAJECTORY,
    seq: str = SEQ,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rolling score, changes of score and health, recent persistence, and the pattern."""

    def build(x: DataFrame, w):
        frame = trailing(w, rows)
        clean = x.withColumns({score: unit_clip(score), health: clip(finite_or(health, 0.0), 0.0, 100.0)})
        return clean.withColumns({
            "anomaly_score_rolling_mean": F.avg(score).over(frame),
            "anomaly_score_delta": difference(score, w),
            "health_index_delta": difference(health, w),
            "anomaly_persistence_score_temporal": F.avg((F.col(score) >= threshold).cast("double")).over(frame),
        })

    out = in_blocks(df, rows - 1, build, keys, seq, block_rows)
    return out.withColumn("temporal_pattern", temporal_pattern(
        "anomaly_score_delta", "health_index_delta", "anomaly_persistence_score_temporal"))


def temporal_reasoning(df: DataFrame) -> DataFrame:
    """Sentence from the temporal pattern and the row's root-cause pattern."""
    return df.withColumns({
        "temporal_reasoning_text": fmt(
            TEMPORAL_TEXT, "temporal_pattern", fixed("anomaly_persistence_score_temporal", 2),
            fixed("anomaly_score_delta", 4), fixed("health_index_delta", 2), "root_cause_pattern"),
        "maintenance_decision": F.lit(NO_MAINTENANCE),
    })


def pattern_counts(df: DataFrame) -> DataFrame:
    """Counts of pattern, focus and leading sensor, overall and pattern per split.

    The three label columns are counted in one pass; ``split`` is ``all`` for overall rows.
    """
    long = df.select("split", F.inline(F.array(
        F.struct(F.lit("root_cause_pattern").alias("kind"), F.col("root_cause_pattern").alias("name")),
        F.struct(F.lit("inspection_focus").alias("kind"), F.col("inspection_focus").alias("name")),
        F.struct(F.lit("top_sensor_1").alias("kind"), F.col("top_sensor_1").alias("name")),
    )))
    by_split = long.groupBy("kind", "name", "split").agg(F.count(F.lit(1)).alias("row_count"))
    overall = by_split.groupBy("kind", "name").agg(F.sum("row_count").alias("row_count")).withColumn("split", F.lit("all"))
    return overall.unionByName(by_split.where(F.col("kind") == "root_cause_pattern"))
