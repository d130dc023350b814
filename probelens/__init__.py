"""Canary-check analytics on Spark: specs, recorded responses, results, metrics and statuses as tables."""
