"""Readers, writers and the adapters from the test tables."""
