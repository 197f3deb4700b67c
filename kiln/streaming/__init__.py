"""Structured Streaming forms of the batch jobs (file sources, foreachBatch
sinks that are idempotent per batch id)."""
