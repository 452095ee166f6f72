"""Stages of the workflow, and the engine's queries over the test tables."""
