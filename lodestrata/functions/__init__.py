"""Scoring functions as column expressions."""
