"""Spark jobs for multi-lead biosignal collections: ingest, clean, split, score and evaluate."""
