"""Queries that run every operator over the test tables, each with an independent SQL statement."""
