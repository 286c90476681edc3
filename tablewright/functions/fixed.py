"""Parameters and names that results depend on.

Fixed values: they must stay as they are for results to be right.
"""

# Profile
RARE_CATEGORY_SHARE = 0.01
TOP_CATEGORIES = 10
CORRELATION_THRESHOLD = 0.95
TEXT_AVG_LENGTH = 40
HIGH_CARDINALITY_RATIO = 0.5
IMBALANCE_RATIO = 10.0
MISSING_ALERT_PCT = 50.0
REGRESSION_MIN_DISTINCT = 20
DATE_SHARE = 0.9

# Cleaning
DROP_COLUMN_MISSING_SHARE = 0.6
IQR_FACTOR = 1.5
NUMERIC_SHARE = 0.9
IMPUTED_ALERT_SHARE = 0.2
RARE_LABEL = "__rare__"
MISSING_LABEL = "__missing__"

# Features
HIGH_CARDINALITY_LIMIT = 20
TFIDF_TERMS = 50
DATE_PARTS = ("year", "month", "day", "dayofweek", "hour", "quarter", "is_weekend")
TEXT_PARTS = ("char_len", "n_words")

# Splits and seeds
SEED = 42
N_SPLITS = 5
TEST_SIZE = 0.2
SPLIT_STRATEGIES = ("holdout", "kfold", "stratified_kfold", "group_kfold", "time_split")

# Drift and retraining
PSI_THRESHOLD = 0.2
PSI_BINS = 10
PSI_FLOOR = 1e-6
REVIEW_DAYS = 30

# Evaluation, search, explanation
CONFIDENCE = 0.95
SELECTION_RULES = ("best_mean", "one_se")
N_TRIALS = 20
TOP_FEATURES = 15
PERMUTATION_REPEATS = 5
SMALL_TABLE_ROWS = 200

# Tasks and metrics
VALID_METRICS = {
    "classification": ("accuracy", "macro_f1", "weighted_f1", "roc_auc", "average_precision",
                       "log_loss", "balanced_accuracy", "kappa"),
    "regression": ("rmse", "mae", "mse", "r2", "mape", "medae"),
    "anomaly": ("roc_auc", "average_precision", "f1", "precision_at_k"),
}
DEFAULT_METRIC = {"classification": "macro_f1", "regression": "rmse", "anomaly": "roc_auc"}
DEFAULT_SUCCESS = {
    "macro_f1": 0.70, "weighted_f1": 0.70, "accuracy": 0.80, "balanced_accuracy": 0.70,
    "roc_auc": 0.75, "average_precision": 0.60, "r2": 0.60, "kappa": 0.60,
}
SECONDARY_METRICS = {
    "classification": ("roc_auc", "average_precision", "macro_f1", "balanced_accuracy"),
    "regression": ("mae", "rmse", "r2", "mape"),
    "anomaly": ("roc_auc", "average_precision", "f1"),
}
# One list for every step: smaller is better for these.
MINIMISED = ("rmse", "mae", "mse", "mape", "medae", "log_loss", "reconstruction_mse")

# Spellings a CSV reader takes as a missing value (the list pandas documents).
NA_SPELLINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                "nan", "null")
