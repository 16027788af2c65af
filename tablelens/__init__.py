"""tablelens: table profiling, feature engineering, model training and scoring
as Spark DataFrame operators."""

__version__ = "0.1.0"
