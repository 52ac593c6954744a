"""Readers of artefact trees."""
