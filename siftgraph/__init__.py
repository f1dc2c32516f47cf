"""Spark analytics over application graphs, source code and their findings."""
