"""Continuous ingest, windows and triggers."""
