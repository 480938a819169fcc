"""Code-review analytics on Spark: payloads, diffs, rule scans, feedback memory, reports."""

__version__ = "0.1.0"
