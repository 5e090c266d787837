"""Operators that prepare training data for language models, all as Spark jobs."""
