"""Batch jobs that link organisations to their official web domains, on Spark."""
