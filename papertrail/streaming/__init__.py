"""Incremental ingest with durable per-item state."""
