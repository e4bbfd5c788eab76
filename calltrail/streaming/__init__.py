"""Structured Streaming: ingest (T1, T4), follow (T2, T3), live views."""
