"""Ribosome-profiling analytics on Spark: reads, annotation, sequences, open reading frames, scores and reports."""
