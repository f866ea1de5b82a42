"""Incremental features."""
