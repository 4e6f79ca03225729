"""Structured Streaming: documents annotated as they arrive, and running counts of terms."""
