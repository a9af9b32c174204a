"""Structured Streaming: tables that grow by micro-batches."""
