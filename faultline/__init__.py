"""Spark jobs over build-failure logs: triage, reduction, grounding, evaluation, retrieval, and preparation of training data."""
