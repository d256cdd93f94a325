"""Relational and dataflow operators over procurement views."""
