"""Cohort analytics over clinical-style event data, expressed as Spark DataFrame plans."""
