"""Graph-sampling and training-data jobs expressed as Spark DataFrame programs."""
