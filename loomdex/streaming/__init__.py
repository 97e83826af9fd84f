"""Structured Streaming: log lines in, groups out."""
