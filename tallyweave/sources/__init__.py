"""Scans and sinks, and the lens that shows the star-schema tables as billing data."""
