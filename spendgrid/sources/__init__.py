"""Readers: logical views, catalogs, thresholds, BSON dumps, paged lists."""
