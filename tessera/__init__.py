"""Tessera: corpus, evaluation and telemetry analytics as PySpark plans."""
