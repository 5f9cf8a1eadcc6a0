"""Fixed values shared by the operators.

Every number here is a default that callers can override by argument.
"""

# Split names.
DEV = "dev"
TEST = "test"

# Row window lengths.
ROLLING_ROWS = 5
SEQUENCE_ROWS = 20
LOOKBACK_CYCLES = 20

# Score levels, lowest first.
ALERT_LEVELS = (("Watch", 0.40), ("Warning", 0.65), ("Critical", 0.85))
HEALTH_LEVELS = (("Warning", 40.0), ("Degrading", 65.0), ("Healthy", 85.0))
EARLY_WARNING_LEVELS = (("Watch_Risk", 0.40), ("Increasing_Risk", 0.65))
CONFIDENCE_LEVELS = (
    ("Low_Confidence", 0.40),
    ("Moderate_Confidence", 0.60),
    ("High_Confidence", 0.80),
)
UNCERTAINTY_LEVELS = (
    ("Low_Uncertainty", 0.20),
    ("Moderate_Uncertainty", 0.40),
    ("High_Uncertainty", 0.60),
)

# Residual threshold percentiles.
RESIDUAL_PERCENTILES = (("watch", 0.90), ("warning", 0.95), ("critical", 0.99))

# Weights.
FUSION_WEIGHTS = {
    "residual": 0.35,
    "iforest": 0.20,
    "mahalanobis": 0.20,
    "lstm_autoencoder": 0.25,
}
HEALTH_WEIGHTS = {"score": 60.0, "trend": 25.0, "persistence": 15.0}
CONFIDENCE_WEIGHTS = {
    "model_agreement_score": 0.35,
    "context_confidence": 0.25,
    "anomaly_persistence_score": 0.25,
    "data_quality_score": 0.15,
}

# Feedback labels and how each moves a threshold.
FEEDBACK_STEP = 0.02
FEEDBACK_LABELS = ("accepted_alert", "rejected_false_alarm", "missed_anomaly", "uncertain")

NO_MAINTENANCE = "Not generated by this component"

TRAJECTORY = ("split", "unit_id")
SEQ = "seq"

# Rows of one trajectory that a single window task may sort together.
BLOCK_ROWS = 65_536

# Rows that one task may sort when a table is numbered.
TASK_ROWS = 2_000_000

# Largest parameter table that may be collected and sent to every executor.
LOOKUP_ROWS = 10_000
