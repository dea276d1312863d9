"""sparkslab: Bayesian sparse feature selection on Spark DataFrames."""

__version__ = "0.1.0"
