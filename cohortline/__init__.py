"""Longitudinal cohort analytics as composable Spark DataFrame operators."""
