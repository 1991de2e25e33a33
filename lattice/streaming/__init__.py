"""Structured Streaming: scoring a stream with a fitted pipeline, and profiles of a stream by window."""
