"""Registered queries, their derived inputs and their check SQL."""
