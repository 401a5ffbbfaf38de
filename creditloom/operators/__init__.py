"""DataFrame operators: DataFrame(s) and parameters in, DataFrame out, always lazy."""
