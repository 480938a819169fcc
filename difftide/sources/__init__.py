"""Readers that turn archives and logs into typed tables."""
