"""Intentionally empty: every source is a one-shot file load, so there is no stream to process."""
