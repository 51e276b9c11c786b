"""Manifest, label-file and audio readers; manifest, run and report writers."""
