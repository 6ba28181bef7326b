"""Inkwell: document-workspace analytics on Spark."""
