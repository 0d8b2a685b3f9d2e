"""Structured Streaming versions of the job-event operators."""
