"""Query catalogue over the driver's tables: a Spark query and DuckDB SQL for each."""
