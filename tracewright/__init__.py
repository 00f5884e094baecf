"""Spark-first query engine for hardware waveform dumps and large text corpora."""
