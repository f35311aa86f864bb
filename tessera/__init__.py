"""Tessera: Spark-native operators over cohort genotype, segment and event tables."""
