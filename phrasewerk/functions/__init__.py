"""Column functions: each returns a Spark expression; none calls Python row by row."""
