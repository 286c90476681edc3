"""Table operators on Spark: profile, quality, cleaning, features, folds, models, drift."""

__version__ = "0.1.0"
