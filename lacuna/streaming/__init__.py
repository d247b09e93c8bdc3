"""Streaming forms of the resumable sinks (beyond the batch operators)."""
