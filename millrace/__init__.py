"""Tabular data preparation, charting data and statistics as Spark jobs."""
