"""Training jobs on pyspark.ml."""
