"""Table-level operators: DataFrames in, DataFrames out, nothing evaluated."""
