"""Column functions: expressions only, no Python UDF."""
