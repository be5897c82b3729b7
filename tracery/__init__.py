"""Evidence analytics on Spark: DataFrame-first operators, sources, functions, plans and streams."""
