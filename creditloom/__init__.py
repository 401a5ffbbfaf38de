"""creditloom: DataFrame operators for credit-risk features, scores and Spark job health."""

__version__ = "0.1.0"
