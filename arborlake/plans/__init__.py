"""Plans of the morphology engine."""
