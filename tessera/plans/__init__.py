"""Composed plans: the fitted feature plan, the training workflow and the
flagship profile."""
