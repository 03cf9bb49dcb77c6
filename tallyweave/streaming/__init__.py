"""Streams: document ingest, content dedupe, late arrivals, running totals."""
