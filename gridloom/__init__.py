"""Tabular analytics as Spark jobs: every operator takes a DataFrame and returns one."""
