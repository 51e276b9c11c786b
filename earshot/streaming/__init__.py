"""Metric reduction over a growing training log."""
