"""Time-travel analytics over event-sourced tables, on plain Spark DataFrames."""
