"""Streaming of the morphology engine."""
