"""Structured Streaming: detection of arriving documents."""
