"""Pseudonymisation, restoration, comparison and audit of text tables on Spark."""
