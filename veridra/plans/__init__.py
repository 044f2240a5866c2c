"""Schemas, their resolution, and the compilation of checks to columns."""
