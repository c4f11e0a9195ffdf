"""Incremental construction."""
