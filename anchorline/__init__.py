"""Anchored time-series cohort analytics expressed as Spark DataFrame plans."""
