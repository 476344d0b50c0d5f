"""Column functions: codes, flag expressions, genotype algebra, partition bins, statistics."""
