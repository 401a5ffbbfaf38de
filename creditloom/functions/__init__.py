"""Column builders: they take and return Columns and never touch a DataFrame."""
