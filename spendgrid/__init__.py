"""Procurement-style spend analytics as Spark jobs."""
