"""Scans and sinks: driver tables, dataset profiles, result files."""
