"""Operators of the morphology engine."""
