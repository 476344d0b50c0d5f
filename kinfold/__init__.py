"""Family genotype and phenotype analytics as Spark DataFrame operations."""
