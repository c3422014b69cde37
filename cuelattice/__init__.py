"""Timed-text analytics as composable Spark DataFrame operators."""
