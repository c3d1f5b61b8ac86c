"""Spark jobs for the tables around large computing campaigns."""
