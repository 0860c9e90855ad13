"""DataFrame operators: each takes and returns DataFrames and is lazy."""
