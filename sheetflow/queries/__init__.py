"""Queries over the test tables, one module for each part of the engine."""
