"""Operators that prepare the telemetry archive's texts for language models, on Spark."""
